"""Joins by place: points in buckets as wide as the radius, cells and triangles in the buckets they touch, then exactly."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths as M
from .grid import Layers


def with_xyz(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.withColumns(dict(zip("xyz", M.xyz(F.col(lon), F.col(lat)), strict=True)))


def _bucket(c: Column, width: float) -> Column:
    return F.floor(c / width).cast("int")


def within(nodes: DataFrame, obs: DataFrame, radius: float | dict[str, float]) -> DataFrame:
    """Pairs of nodes (node, x, y, z) and obs (id, x, y, z, ...) whose chord is at most radius, as d.

    radius: one for all, or by type of observation. Only the nodes, which are fewer, are repeated: into the 27 buckets
    around theirs. Nothing is broadcast, and a dense bucket's join partition is one that adaptive execution can split.
    """
    widest = max(radius.values()) if isinstance(radius, dict) else radius
    around = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip("xyz", s, strict=True)]) for s in product((-1, 0, 1), repeat=3)])
    left = nodes.select("node", *[F.col(c).alias(f"n{c}") for c in "xyz"], *[_bucket(F.col(c), widest).alias(f"b{c}") for c in "xyz"]).withColumn("s", F.explode(around))
    left = left.select("node", "nx", "ny", "nz", *[(F.col(f"b{c}") + F.col(f"s.{c}")).alias(f"b{c}") for c in "xyz"])
    right = obs.withColumns({f"b{c}": _bucket(F.col(c), widest) for c in "xyz"})
    square = sum(((F.col(f"n{c}") - F.col(c)) * (F.col(f"n{c}") - F.col(c)) for c in "xyz"), F.lit(0.0))
    reach = F.lit(float(radius)) if not isinstance(radius, dict) else F.element_at(F.create_map(*[F.lit(v) for kv in radius.items() for v in kv]), F.col("type"))
    return left.join(right, ["bx", "by", "bz"]).withColumn("d", F.sqrt(square)).where(F.col("d") <= reach).drop("bx", "by", "bz", "nx", "ny", "nz")


def everywhere(nodes: DataFrame, obs: DataFrame) -> DataFrame:
    """The pairs of a global analysis, which has one node: every observation, with coefficient 1."""
    one = nodes.select("node").limit(2).collect()
    if len(one) != 1:
        raise ValueError("a global analysis has one node")
    return obs.withColumns({"node": F.lit(one[0].node), "d": F.lit(0.0), "coeff": F.lit(1.0)})


def nearest(pairs: DataFrame, k: int, by: tuple[str, ...] = ("node", "type")) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("d", "id")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest_node(obs: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """id, node, d: the nearest node within a radius, of equally near ones the first."""
    pairs = within(nodes, obs.select("id", "x", "y", "z"), radius)
    return pairs.groupBy("id").agg(F.min(F.struct("d", "node")).alias("m")).select("id", "m.node", "m.d")


def footprint(obs: DataFrame, nodes: DataFrame, field: DataFrame) -> DataFrame:
    """id, he: plain means of the field (node, e) over the nodes within each observation's footprint (null: none there)."""
    widest = obs.agg(F.max("footprint")).first()[0] or 1.0
    pairs = within(nodes, obs.select("id", "x", "y", "z", "footprint"), widest).where("d <= footprint")
    met = pairs.select("id", "node").join(field, "node").select("id", "e", F.lit(1.0).alias("w"))
    return obs.select("id").join(mean_members(met), "id", "left")


def corners(obs: DataFrame, ni: int, nj: int, periodic: bool = True) -> DataFrame:
    """Four rows (i, j, weight) for each observation's cell; i wraps or, like j, is held within the grid."""
    parts = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (0, 1) for b in (0, 1)])
    out = obs.withColumns({"i0": F.floor("fi").cast("int"), "j0": F.floor("fj").cast("int")}).withColumn("c", F.explode(parts))
    u, v = F.col("fi") - F.col("i0"), F.col("fj") - F.col("j0")
    weight = F.when(F.col("c.di") == 1, u).otherwise(1 - u) * F.when(F.col("c.dj") == 1, v).otherwise(1 - v)
    i, j = F.col("i0") + F.col("c.di"), F.col("j0") + F.col("c.dj")
    i = F.pmod(i, F.lit(ni)) if periodic else F.greatest(F.lit(0), F.least(i, F.lit(ni - 1)))
    return out.withColumns({"weight": weight, "i": i.cast("int"), "j": F.greatest(F.lit(0), F.least(j, F.lit(nj - 1))).cast("int")}).drop("c", "i0", "j0")


def corners_3d(obs: DataFrame, ni: int, nj: int, nk: int, periodic: bool = True) -> DataFrame:
    """Up to eight rows (i, j, k, weight) for each observation; beyond the centres of the outer layers it is the layer's."""
    fk = F.greatest(F.lit(0.0), F.least(F.col("fk"), F.lit(float(nk - 1))))
    k0 = F.floor(fk)
    out = corners(obs, ni, nj, periodic).withColumn("c", F.explode(F.array(*[F.struct(k.cast("int").alias("k"), w.alias("w")) for k, w in ((k0, 1 - (fk - k0)), (k0 + 1, fk - k0))])))
    return out.withColumns({"k": F.col("c.k"), "weight": F.col("weight") * F.col("c.w")}).drop("c").where("weight > 0")


def mean_members(met: DataFrame) -> DataFrame:
    """id, he: means of members (e) by weights (w) over the few rows of each id."""
    held = met.where("w > 0").groupBy("id").agg(F.collect_list(F.struct("w", "e")).alias("c"), F.sum("w").alias("total"))  # a cell's corners
    add = lambda a, x: F.zip_with(a, x["e"], lambda p, q: p + q * x["w"])
    zero = F.transform(F.col("c")[0]["e"], lambda x: F.lit(0.0))
    return held.select("id", F.transform(F.aggregate("c", zero, add), lambda x: x / F.col("total")).alias("he"))


def interpolated(obs: DataFrame, field: DataFrame, ni: int, nj: int, periodic: bool = True) -> DataFrame:
    """id, hx: the mean of the wet corners' values by their weights (field: i, j, v, wet)."""
    met = corners(obs.select("id", "fi", "fj"), ni, nj, periodic).join(field, ["i", "j"]).where("wet and weight > 0")
    return met.groupBy("id").agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("hx"))


def members_2d(obs: DataFrame, field: DataFrame, nodes: DataFrame, ni: int, nj: int, periodic: bool = True) -> DataFrame:
    """id, he: every member of a layer (j, i, e; t too, if there is a slot) at the observations, from wet corners."""
    on = ["j", "i"] + (["t"] if "t" in field.columns and "t" in obs.columns else [])
    at = corners(obs.select("id", "fi", "fj", *on[2:]), ni, nj, periodic).where("weight > 0")
    met = at.join(nodes.where("numlevels > 0").select("j", "i"), ["j", "i"]).join(field.select(*on, "e"), on)
    return mean_members(met.select("id", F.col("weight").alias("w"), "e"))


def members_3d(obs: DataFrame, field: DataFrame, nodes: DataFrame, ni: int, nj: int, layers: Layers, periodic: bool = True) -> DataFrame:
    """id, he: every member of a variable (k, j, i, e; t too) at the observations, from corners that have water there."""
    on = ["k", "j", "i"] + (["t"] if "t" in field.columns and "t" in obs.columns else [])
    at = corners_3d(obs.select("id", "fi", "fj", "fk", *on[3:]), ni, nj, len(layers.centres), periodic)
    wet = at.join(nodes.select("j", "i", "numlevels"), ["j", "i"]).where(F.col("numlevels") > layers.from_surface(F.col("k")))
    return mean_members(wet.join(field.select(*on, "e"), on).select("id", F.col("weight").alias("w"), "e"))


def _cross(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def _touched(df: DataFrame, corners: list[tuple[Column, ...]], width: float, margin: float, names: str) -> DataFrame:
    """df once for each bucket that the box around its corners (and a margin) touches."""
    for n, axis in zip(names, zip(*corners, strict=True), strict=True):
        low, high = F.least(*axis) - margin, F.greatest(*axis) + margin
        df = df.withColumn(f"b{n}", F.explode(F.sequence(_bucket(low, width), _bucket(high, width))))
    return df


def quads(nodes: DataFrame) -> DataFrame:
    """j, i and corner coordinates a, b, c, d (lon, lat; around the cell) of a curvilinear grid's cells (nodes: j, i, lon, lat)."""
    at = lambda dj, di, n: nodes.select((F.col("j") - dj).alias("j"), (F.col("i") - di).alias("i"), F.col("lon").alias(f"{n}_lon"), F.col("lat").alias(f"{n}_lat"))
    return at(0, 0, "a").join(at(0, 1, "b"), ["j", "i"]).join(at(1, 1, "c"), ["j", "i"]).join(at(1, 0, "d"), ["j", "i"])


def in_quads(obs: DataFrame, cells: DataFrame, width: float, stereographic: bool = False) -> DataFrame:
    """id, fi, fj of obs (id, lon, lat) in a curvilinear grid's cells: the inverse of the bilinear map of the cell they lie in.

    Cells are met in buckets of xyz (width in km, about a cell's). stereographic: coordinates are projected from the pole
    of the other hemisphere, where grids with singular longitudes are smooth; otherwise they are degrees, relative to the
    point. Of several cells, as on an edge, the first one counts. Nothing is collected or broadcast.
    """
    xyz = {n: M.xyz(F.col(f"{n}_lon"), F.col(f"{n}_lat")) for n in "abcd"}
    left = _touched(cells, list(xyz.values()), width, width / 8, "xyz")
    right = with_xyz(obs.select("id", "lon", "lat")).select("id", "lon", "lat", *[_bucket(F.col(c), width).alias(f"b{c}") for c in "xyz"])
    met = right.join(left, ["bx", "by", "bz"])
    wrap = lambda x: F.pmod(x + 180, F.lit(360.0)) - 180

    def plane(lon: Column, lat: Column) -> tuple[Column, Column]:
        if not stereographic:
            return wrap(lon - F.col("lon")), lat - F.col("lat")
        south = F.when(F.col("lat") < 0, -1.0).otherwise(1.0)  # the hemisphere of the point decides for its cell too
        r = 1 / F.tan(3.141592653589793 / 4 + F.radians(lat * south) / 2)
        return r * F.cos(F.radians(lon)), r * F.sin(F.radians(lon))

    at = {n: plane(F.col(f"{n}_lon"), F.col(f"{n}_lat")) for n in "abcd"}
    at["p"] = plane(F.col("lon"), F.col("lat"))
    for n, (x, y) in at.items():
        met = met.withColumns({f"{n}x": x, f"{n}y": y})
    p = {n: (F.col(f"{n}x"), F.col(f"{n}y")) for n in "abcdp"}
    minus = lambda s, t: (p[s][0] - p[t][0], p[s][1] - p[t][1])
    b, d, q = minus("b", "a"), minus("d", "a"), minus("p", "a")
    e = tuple(p["a"][z] - p["b"][z] + p["c"][z] - p["d"][z] for z in (0, 1))
    # q = u b + v d + u v e, so v solves a quadratic equation
    two, one, none = _cross(d, e), _cross(d, b) - _cross(q, e), -_cross(q, b)
    met = met.withColumns({"two": two, "one": one, "none": none})
    root = F.sqrt(F.greatest(F.col("one") * F.col("one") - 4 * F.col("two") * F.col("none"), F.lit(0.0)))
    stable = -0.5 * (F.col("one") + F.when(F.col("one") < 0, -root).otherwise(root))
    found = F.array(F.when(stable != 0, F.col("none") / stable), F.when(F.abs("two") > 0, stable / F.col("two")))
    met = met.withColumn("v", F.explode(found)).where("v >= -1e-9 and v <= 1 + 1e-9")
    side = tuple(b[z] + F.col("v") * e[z] for z in (0, 1))
    u = sum(((q[z] - F.col("v") * d[z]) * side[z] for z in (0, 1)), F.lit(0.0)) / (side[0] * side[0] + side[1] * side[1])
    met = met.withColumn("u", u).where("u >= -1e-9 and u <= 1 + 1e-9")
    first = F.min(F.struct("j", "i", "u", "v")).alias("m")
    return met.groupBy("id").agg(first).select("id", (F.col("m.i") + F.greatest(F.lit(0.0), F.least(F.col("m.u"), F.lit(1.0)))).alias("fi"), (F.col("m.j") + F.greatest(F.lit(0.0), F.least(F.col("m.v"), F.lit(1.0)))).alias("fj"))


def quad_places(obs: DataFrame, cells: DataFrame) -> DataFrame:
    """lon and lat of fractional indices (id, fi, fj) in a curvilinear grid's cells."""
    u, v = F.col("fi") - F.floor("fi"), F.col("fj") - F.floor("fj")
    met = obs.withColumns({"i": F.floor("fi").cast("int"), "j": F.floor("fj").cast("int")}).join(cells, ["j", "i"])
    near = lambda n: F.pmod(F.col(f"{n}_lon") - F.col("a_lon") + 180, F.lit(360.0)) - 180 + F.col("a_lon")
    mix = lambda f: (1 - v) * ((1 - u) * f("a") + u * f("b")) + v * ((1 - u) * f("d") + u * f("c"))
    return met.select("id", mix(near).alias("lon"), mix(lambda n: F.col(f"{n}_lat")).alias("lat"))


def in_triangles(obs: DataFrame, triangles: DataFrame, width: float) -> DataFrame:
    """id, triangle, vertices v0 to v2 and weights w0 to w2 of obs (id, x, y) in triangles (triangle, v0.., x0, y0..)."""
    left = _touched(triangles, [(F.col(f"x{n}"), F.col(f"y{n}")) for n in range(3)], width, 0.0, "xy")
    met = obs.select("id", "x", "y", _bucket(F.col("x"), width).alias("bx"), _bucket(F.col("y"), width).alias("by")).join(left, ["bx", "by"])
    dx, dy = [F.col(f"x{n}") - F.col("x2") for n in (0, 1)], [F.col(f"y{n}") - F.col("y2") for n in (0, 1)]
    px, py = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    det = dx[0] * dy[1] - dx[1] * dy[0]
    met = met.withColumns({"w0": (px * dy[1] - py * dx[1]) / det, "w1": (py * dx[0] - px * dy[0]) / det}).withColumn("w2", 1 - F.col("w0") - F.col("w1"))
    inside = met.where("w0 >= -1e-12 and w1 >= -1e-12 and w2 >= -1e-12")
    names = [f"{c}{n}" for c in "vw" for n in range(3)]
    return inside.groupBy("id").agg(F.min(F.struct("triangle", *names)).alias("m")).select("id", "m.*")


def _held(parts: DataFrame, on: list[str]) -> DataFrame:
    """A row for each place (on) with the members (n, e) of its few vertices, in order of n, and these n alone."""
    held = parts.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("c"))  # a cell's corners
    return held.withColumn("ns", F.transform("c", lambda x: x["n"]))


def _members_at(obs: DataFrame, places: DataFrame, on: list[str], least: float = 0.0) -> DataFrame:
    """id, he: means of the members at each observation's place by its own weights (ws; vertex n's at n), above a least sum.

    A place's members are put together once, so an observation carries numbers only up to its join with its place, and
    nothing is sorted or shuffled after that.
    """
    met = obs.join(places, on)
    total = F.aggregate("ns", F.lit(0.0), lambda a, n: a + F.greatest(F.col("ws")[n], F.lit(0.0)))
    met = met.where(total > least).select("id", total.alias("total"), F.filter(F.transform("c", lambda x: F.struct(F.col("ws")[x["n"]].alias("w"), x["e"].alias("e"))), lambda x: x["w"] > 0).alias("c"))
    add = lambda a, x: F.zip_with(a, x["e"], lambda p, q: p + q * x["w"])
    zero = F.transform(F.col("c")[0]["e"], lambda x: F.lit(0.0))
    return met.select("id", F.transform(F.aggregate("c", zero, add), lambda x: x / F.col("total")).alias("he"))


def _both_layers(fk: Column, nk: int) -> tuple[Column, Column]:
    """The layer at or above a fractional one, and how far below it; beyond the centres of the outer layers it is the layer's."""
    held = F.greatest(F.lit(0.0), F.least(fk, F.lit(float(nk - 1))))
    return F.floor(held).cast("int"), held - F.floor(held)


def _in_layers(parts: DataFrame) -> DataFrame:
    """Vertices (n) of places that have a layer k0, at it and at the next, as 2 n and 2 n + 1."""
    out = parts.withColumn("dk", F.explode(F.array(F.lit(0), F.lit(1))))
    return out.withColumns({"n": 2 * F.col("n") + F.col("dk"), "k": F.col("k0") + F.col("dk")}).drop("dk")


def _layer_weights(weights: Column, below: Column) -> Column:
    """Weights of vertices n at the layers 2 n and 2 n + 1."""
    return F.flatten(F.transform(weights, lambda w: F.array(w * (1 - below), w * below)))


def members_of_triangles(placed: DataFrame, field: DataFrame, nodes: DataFrame, layers: Layers | None = None, least: float = 0.0) -> DataFrame:
    """id, he from the vertices of each observation's triangle (of in_triangles; fk too for fields of several layers).

    field: node, e and, with layers, k; nodes: node, numlevels. Only vertices that have water there count, and only
    observations whose weights of such ones come to more than a least sum.
    """
    on = ["v0", "v1", "v2"]
    vertices = F.posexplode(F.array(*on)).alias("n", "node")
    weights = F.array("w0", "w1", "w2")
    if layers is None:
        at = placed.select("id", *on, weights.alias("ws"))
        wet = at.select(*on).distinct().select(*on, vertices).join(nodes.where("numlevels > 0").select("node"), "node")
        return _members_at(at, _held(wet.join(field.select("node", "e"), "node"), on), on, least)
    k0, below = _both_layers(F.col("fk"), len(layers.centres))
    at = placed.select("id", *on, k0.alias("k0"), _layer_weights(weights, below).alias("ws"))
    on = [*on, "k0"]
    wet = _in_layers(at.select(*on).distinct().select(*on, vertices)).join(nodes.select("node", "numlevels"), "node").where(F.col("numlevels") > layers.from_surface(F.col("k")))
    return _members_at(at, _held(wet.join(field.select("node", "k", "e"), ["node", "k"]), on), on, least)
