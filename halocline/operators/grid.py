"""Grids: axes, cells, layers, and the mapping of observations into them.

A grid's nodes are a DataFrame, so it may be as large as it likes. Each cell has one row with its four corners, made by
one shuffle of the nodes; an observation meets its cell in one equi-join on whole indices, whatever the grid's kind.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maths as M

CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))  # steps along j and i


@dataclass(frozen=True)
class Axis:
    """Nodes of one axis. cyclic: of longitudes, which may close on themselves."""

    nodes: tuple[float, ...]
    cyclic: bool = False

    def __post_init__(self):
        steps = [b - a for a, b in zip(self.nodes, self.nodes[1:])]  # noqa: B905
        if len(self.nodes) < 2 or not (all(d > 0 for d in steps) or all(d < 0 for d in steps)):
            raise ValueError("an axis is monotonic and has two nodes or more")

    @cached_property
    def periodicity(self) -> int:
        """0: open; 1: the last node is the first one again; 2: the one after the last would be."""
        if not self.cyclic:
            return 0
        x = self.nodes
        whole = lambda d: abs(d - 360 * round(d / 360)) < 1e-3 and abs(d) > 1
        return 1 if whole(x[-1] - x[0]) else 2 if whole(2 * x[-1] - x[-2] - x[0]) else 0

    @cached_property
    def closed(self) -> tuple[float, ...]:
        return (*self.nodes, 2 * self.nodes[-1] - self.nodes[-2]) if self.periodicity == 2 else self.nodes

    @cached_property
    def regular(self) -> bool:
        x = self.nodes
        step = (x[-1] - x[0]) / (len(x) - 1)
        return all(abs(b - a - step) <= 1e-3 * abs(step) for a, b in zip(x, x[1:]))  # noqa: B905

    @cached_property
    def edges(self) -> tuple[float, ...]:
        """Of the cells around nodes: each node in the middle of its own, from half a step before the first on.

        Where such edges would not be monotonic, edges lie half way between nodes.
        """
        x = self.closed
        out = [1.5 * x[0] - 0.5 * x[1]]
        for v in x:
            out.append(2 * v - out[-1])
        up = x[-1] > x[0]
        if all((b - a > 0) == up and (a - v) * (b - v) < 0 for a, b, v in zip(out, out[1:], x)):  # noqa: B905
            return tuple(out)
        return (1.5 * x[0] - 0.5 * x[1], *[(a + b) / 2 for a, b in zip(x, x[1:])], 1.5 * x[-1] - 0.5 * x[-2])  # noqa: B905

    @property
    def base(self) -> float | None:
        """Longitudes are taken from here to 360 degrees further east."""
        return None if not self.cyclic else self.nodes[0] if self.periodicity else (0.0 if min(self.nodes) >= 0 else -180.0)

    def index(self, x: Column) -> Column:
        if self.cyclic:
            x = M.normal_lon(x, self.base)
        if self.regular:
            return M.regular_index(x, self.closed[0], self.closed[-1], len(self.closed), bool(self.periodicity))
        return M.irregular_index(x, list(self.closed), list(self.edges))

    def coordinate(self, f: Column) -> Column:
        return M.axis_coordinate(f, list(self.closed), bool(self.periodicity))


def default_edges(centres: tuple[float, ...], to_surface: bool = False) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Centres and edges of layers from centres alone: depths turn positive, and the surface is at 0."""
    z = tuple(-v for v in centres) if sum(centres) < 0 else tuple(centres)
    out = [0.0]
    for v in reversed(z) if to_surface else z:
        out.append(2 * v - out[-1])
    return z, tuple(reversed(out) if to_surface else out)


@dataclass(frozen=True)
class Layers:
    """Layers of a grid. kind: z (edges), zt (centres only), sigma, hybrid or numeric; none has no layers.

    sigma: centres and edges hold (s, c) pairs. hybrid: (a, b) pairs of the pressures p1 and p2. numeric: each node's own
    arrays zt and zc.
    """

    kind: str = "z"
    centres: tuple = ()
    edges: tuple = ()
    hc: float = 0.0
    to_surface: bool = False

    @property
    def surface(self) -> int:
        return len(self.centres) - 1 if self.to_surface else 0

    def arrays(self, h: Column | None = None, p1: Column | None = None, p2: Column | None = None, zt: Column | None = None, zc: Column | None = None) -> tuple[Column, Column]:
        """Edges and centres at a place: of depth h, pressures p1 and p2, or interpolated arrays."""
        if self.kind == "sigma":
            return tuple(M.sigma_layers(h, [x[0] for x in v], [x[1] for x in v], self.hc) for v in (self.edges, self.centres))
        if self.kind == "hybrid":
            return tuple(F.array(*[F.lit(float(a)) + F.lit(float(b)) * (p1 - p2) for a, b in v]) for v in (self.edges, self.centres))
        if self.kind == "numeric":
            return zc, zt
        return M.numbers(self.edges), M.numbers(self.centres)

    def index(self, z: Column, **at: Column) -> Column:
        if self.kind == "zt":
            return M.centre_index(z, list(self.centres))
        return M.layer_index(z, *self.arrays(**at))

    def depth(self, fk: Column, **at: Column) -> Column:
        if self.kind == "zt":
            return M.centre_depth(fk, list(self.centres))
        return M.layer_depth(fk, *self.arrays(**at))

    def from_surface(self, k: Column) -> Column:
        """How many layers lie above a layer."""
        return F.abs(F.lit(self.surface) - k)


@dataclass(frozen=True)
class Grid:
    """nodes: j, i, numlevels and depth (null: unknown) of every node, and whatever the layers need."""

    name: str
    x: Axis
    y: Axis
    layers: Layers
    nodes: DataFrame
    stride: int = 1
    sobstride: int = 1
    domain: str = "ALL"
    alias: str | None = None  # a grid whose nodes and transforms this one shares

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.y.nodes), len(self.x.nodes)

    @property
    def transforms(self) -> str:
        return self.alias or self.name

    def indexed(self, obs: DataFrame) -> DataFrame:
        return obs.withColumns({"fi": self.x.index(F.col("lon")), "fj": self.y.index(F.col("lat"))})

    def located(self, df: DataFrame) -> DataFrame:
        """lon and lat of fractional indices fi, fj."""
        return df.withColumns({"lon": self.x.coordinate(F.col("fi")), "lat": self.y.coordinate(F.col("fj"))})

    def cells(self) -> DataFrame:
        return cells(self.nodes, *self.shape, bool(self.x.periodicity))

    def mapped(self, obs: DataFrame) -> DataFrame:
        """obs (lon, lat, depth) with fi, fj, fk, the water's depth there and map_status: OK, GRID or LAND."""
        return with_layers(with_corners(self.indexed(obs), self.cells()), self.layers)


def cells(nodes: DataFrame, nj: int, ni: int, periodic: bool) -> DataFrame:
    """cj, ci and corner arrays (numlevels, depth; place 2 dj + di) of every cell; the grid's edge repeats itself or wraps."""
    corner = F.array(*[F.struct(F.lit(b).alias("di"), F.lit(a).alias("dj"), F.lit(2 * a + b).alias("place")) for a, b in CORNERS])
    out = nodes.select("j", "i", "numlevels", "depth", F.explode(corner).alias("c"))
    i, j = F.col("i") - F.col("c.di"), F.col("j") - F.col("c.dj")
    out = out.select((F.pmod(i, F.lit(ni)) if periodic else i).cast("int").alias("ci"), j.cast("int").alias("cj"), F.struct(F.col("c.place").alias("place"), "numlevels", "depth").alias("n"))
    at = F.sort_array(F.collect_list("n"))  # four at most
    met = out.where("ci >= 0 and cj >= 0").groupBy("cj", "ci").agg(at.alias("n"))
    # a cell beyond the last row or column has its near corners only
    place = F.map_from_entries(F.transform("n", lambda x: F.struct(x["place"], x)))
    near = lambda p: F.coalesce(F.try_element_at("m", F.lit(p)), F.try_element_at("m", F.lit(p & 2)), F.try_element_at("m", F.lit(p & 1)), F.try_element_at("m", F.lit(0)))
    met = met.select("cj", "ci", place.alias("m")).select("cj", "ci", F.array(*[near(p) for p in range(4)]).alias("n"))
    return met.select("cj", "ci", F.transform("n", lambda x: x["numlevels"]).alias("corner_levels"), F.transform("n", lambda x: x["depth"]).alias("corner_depths"))


def corner_weights(fi: Column, fj: Column) -> Column:
    """Bilinear weights of a cell's corners (place 2 dj + di)."""
    u, v = fi - F.floor(fi), fj - F.floor(fj)
    return F.array((1 - v) * (1 - u), (1 - v) * u, v * (1 - u), v * u)


def weighted(values: Column, weights: Column) -> Column:
    """The mean by weights; null without any."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    return F.when(total > 0, F.aggregate(F.zip_with(values, weights, lambda x, w: F.when(w > 0, x * w).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x) / total)


def with_corners(obs: DataFrame, cells: DataFrame) -> DataFrame:
    """obs (fi, fj) with their cell's corners, weights of the wet ones, and model_depth."""
    out = obs.withColumns({"ci": F.floor("fi").cast("int"), "cj": F.floor("fj").cast("int")}).join(cells, ["cj", "ci"], "left").drop("cj", "ci")
    wet = F.zip_with("corner_levels", corner_weights(F.col("fi"), F.col("fj")), lambda n, w: F.when(n > 0, w).otherwise(0.0))
    out = out.withColumn("weights", wet)
    return out.withColumn("model_depth", F.abs(weighted(F.col("corner_depths").cast("array<double>"), F.col("weights"))))


def with_layers(obs: DataFrame, layers: Layers) -> DataFrame:
    """fk and map_status. In a partly dry cell of z layers, what lies deeper than the interpolated depth is land."""
    h = F.col("model_depth")
    if layers.kind == "none":
        fk = F.lit(0.0)
    elif layers.kind == "hybrid":
        fk = layers.index(F.col("depth"), p1=F.col("p1"), p2=F.col("p2"))
    elif layers.kind == "numeric":
        fk = layers.index(F.col("depth"), zt=F.col("zt"), zc=F.col("zc"))
    else:
        fk = layers.index(F.col("depth"), h=h)
    out = obs.withColumn("fk", fk)
    outside = F.col("fi").isNull() | F.col("fj").isNull() | F.col("corner_levels").isNull()
    touched = corner_weights(F.col("fi"), F.col("fj"))
    dry = lambda k: F.zip_with("corner_levels", touched, lambda n, w: (w > 0) & (n <= k))
    all_dry = lambda k: ~F.exists(F.zip_with("corner_levels", touched, lambda n, w: (w > 0) & (n > k)), lambda x: x)
    status = F.when(outside, "GRID").when(all_dry(F.lit(0)), "LAND").when(F.col("fk").isNull(), "GRID")
    if layers.kind == "z":
        k = (F.lit(layers.surface) - F.ceil("fk")) if layers.surface else F.floor("fk")
        status = status.when(all_dry(k), "LAND").when(F.exists(dry(k), lambda x: x) & F.coalesce(F.col("depth") > h, F.lit(False)), "LAND")
    return out.withColumn("map_status", status.otherwise("OK"))


def island(corner_levels: Column, weights: Column, fk: Column, surface: int = 0) -> Column:
    """Whether none of a place's corners has water at its layer."""
    whole = F.ceil(fk) == F.floor(fk)
    if surface:
        k = surface - F.floor(fk) + F.when(whole, 1).otherwise(0)
    else:
        k = F.ceil(fk) + F.when(whole, 1).otherwise(0)
    k = F.coalesce(k, F.lit(surface))
    wet = lambda n: F.when(k == 0, n > 0).otherwise(n >= k)
    return ~F.exists(F.zip_with(corner_levels, weights, lambda n, w: (w > 0) & wet(n)), lambda x: x)


def derived_levels(nodes: DataFrame, layers: Layers) -> DataFrame:
    """numlevels from depth: of z layers those it reaches, of others all or none; all where the depth is unknown."""
    n, known = len(layers.centres), F.col("depth").isNotNull()
    if layers.kind in ("sigma", "hybrid"):
        return nodes.withColumn("numlevels", F.when(known & (F.col("depth") <= 0), 0).otherwise(n))
    reach = M.levels_at(F.col("depth"), *layers.arrays()) if layers.kind == "z" else F.lit(n)
    return nodes.withColumn("numlevels", F.when(known, reach).otherwise(n).cast("int"))


def strided(nodes: DataFrame, stride: int) -> DataFrame:
    """The nodes that are analysed: each stride-th one along both axes."""
    return nodes.where((F.col("i") % stride == 0) & (F.col("j") % stride == 0))
