"""Observation functions: what every member of the ensemble has at the observations.

A field table has a row for each element of the state: var, t (slot, for asynchronous types), k, j, i and e, all its
members in one array. Each function reads the layers it needs, so a table laid out by var and k is read in part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maths as M
from . import spatial
from .grid import Grid


@dataclass(frozen=True)
class Source:
    """What observation functions read: fields, and offsets (k, j, i, offset, as far as they apply) of a type."""

    grid: Grid
    fields: DataFrame
    members: int
    offset: DataFrame | None = None
    dynamic: int | None = None  # members before the static ones of a hybrid ensemble
    mld_threshold: float | None = None

    @property
    def periodic(self) -> bool:
        return bool(self.grid.x.periodicity)

    def variable(self, name: str) -> DataFrame:
        return self.fields.where(F.col("var") == name).drop("var")

    def without_offset(self, field: DataFrame) -> DataFrame:
        """The field less the offset, which has those of k, j and i that it depends on."""
        if self.offset is None:
            return field
        on = [c for c in ("k", "j", "i") if c in self.offset.columns]
        return field.join(self.offset, on).withColumn("e", F.transform("e", lambda x: x - F.col("offset"))).drop("offset")

    def at_surface(self, obs: DataFrame, layer: DataFrame) -> DataFrame:
        """id, he of a layer: from the corners around a point, or the plain mean over a footprint."""
        nj, ni = self.grid.shape
        plain = obs if "footprint" not in obs.columns else obs.where("footprint is null or footprint = 0")
        out = spatial.members_2d(plain, layer, self.grid.nodes, ni, nj, self.periodic)
        if "footprint" not in obs.columns:
            return out
        wide = obs.where("footprint > 0")
        at = self.grid.located(self.grid.nodes.where("numlevels > 0").select("j", "i", F.col("i").cast("double").alias("fi"), F.col("j").cast("double").alias("fj")))
        node = (F.col("j") * ni + F.col("i")).cast("int").alias("node")
        nodes = spatial.with_xyz(at).select(node, "x", "y", "z")
        return out.unionByName(spatial.footprint(spatial.with_xyz(wide), nodes, layer.select(node, "e")))

    def in_depth(self, obs: DataFrame, field: DataFrame) -> DataFrame:
        nj, ni = self.grid.shape
        return spatial.members_3d(obs, field, self.grid.nodes, ni, nj, self.grid.layers, self.periodic)


def surface_standard(obs: DataFrame, s: Source, names: list[str]) -> DataFrame:
    layer = s.variable(names[0]).where(F.col("k") == s.grid.layers.surface)
    return s.at_surface(obs, s.without_offset(layer))


def _dynamic_only(s: Source, value: Column) -> Column:
    """Values of the dynamic members, 0 for the static ones of a hybrid ensemble."""
    return value if s.dynamic is None else F.transform(value, lambda x, i: F.when(i < s.dynamic, x).otherwise(0.0))


def surface_biased(obs: DataFrame, s: Source, names: list[str]) -> DataFrame:
    """Less the offset and each member's own bias field."""
    on = ["j", "i"] + (["t"] if "t" in s.fields.columns else [])
    bias = s.variable(names[1]).select(*on, F.col("e").alias("bias"))
    layer = s.without_offset(s.variable(names[0]).where(F.col("k") == s.grid.layers.surface)).join(bias, on)
    return s.at_surface(obs, layer.withColumn("e", F.zip_with("e", _dynamic_only(s, F.col("bias")), lambda x, b: x - b)).drop("bias"))


def depth_standard(obs: DataFrame, s: Source, names: list[str]) -> DataFrame:
    return s.in_depth(obs, s.without_offset(s.variable(names[0])))


def mixed_layer(s: Source, name: str, threshold: float) -> DataFrame:
    """j, i, e: each member's depth at which a variable first differs from the surface by the threshold.

    Linear between layers; without a crossing it is that of the deepest wet layer, and nothing on land.
    """
    surface, on = s.grid.layers.surface, ["j", "i"] + (["t"] if "t" in s.fields.columns else [])
    wet = s.variable(name).join(s.grid.nodes.where("numlevels > 0").select("j", "i", "numlevels"), ["j", "i"]).where(F.col("numlevels") > s.grid.layers.from_surface(F.col("k")))
    down = F.sort_array(F.collect_list(F.struct(s.grid.layers.from_surface(F.col("k")).alias("n"), "e")))  # a column's layers
    columns = wet.groupBy(*on).agg(down.alias("c"))

    def depth(m: Column) -> Column:
        v = F.transform("c", lambda x: x["e"][m])
        far = F.transform(v, lambda x: F.abs(x - v[0]))
        n = F.array_position(F.transform(far, lambda x: x >= threshold), F.lit(True)).cast("int") - 1
        crossed = n - 1 + (threshold - F.element_at(far, F.greatest(n, F.lit(1)))) / F.abs(v[n] - F.element_at(v, F.greatest(n, F.lit(1))))
        below = F.when(n > 0, crossed).otherwise(F.size("c") - 1.0)
        return s.grid.layers.depth(below if not surface else surface - below)

    return columns.select(*on, F.transform(F.sequence(F.lit(0), F.lit(s.members - 1)), depth).alias("e"))


def depth_with_surface_bias(obs: DataFrame, s: Source, names: list[str]) -> DataFrame:
    """Less the surface bias, as far as the mixed layer reaches. names: variable, bias, and the mixed layer's unless derived."""
    nj, ni = s.grid.shape
    flat = lambda field: spatial.members_2d(obs, field, s.grid.nodes, ni, nj, s.periodic)
    mld = s.variable(names[2]).drop("k") if len(names) > 2 else mixed_layer(s, names[0], s.mld_threshold)
    out = depth_standard(obs, s, names).join(flat(s.variable(names[1]).drop("k")).withColumnRenamed("he", "bias"), "id").join(flat(mld).withColumnRenamed("he", "mld"), "id").join(obs.select("id", "depth"), "id")
    taken = F.zip_with("mld", _dynamic_only(s, F.col("bias")), lambda m, b: F.coalesce(M.surface_weight(m, F.col("depth")) * b, F.lit(0.0)))
    return out.select("id", F.zip_with("he", taken, lambda x, b: x - b).alias("he"))


def _summed(rows: DataFrame, on: list[str]) -> DataFrame:
    """Member by member sums over a column's layers."""
    held = rows.groupBy(*on).agg(F.collect_list("e").alias("c"))
    zero = F.transform(F.col("c")[0], lambda x: F.lit(0.0))
    return held.select(*on, F.aggregate("c", zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q)).alias("e"))


def vertical_sum(obs: DataFrame, s: Source, names: list[str]) -> DataFrame:
    on = ["j", "i"] + (["t"] if "t" in s.fields.columns else [])
    return s.at_surface(obs, s.without_offset(_summed(s.variable(names[0]), on)))


def vertical_mean(obs: DataFrame, s: Source, names: list[str]) -> DataFrame:
    """Weighted by a second variable; terms that are not positive and finite don't count."""
    on = ["j", "i"] + (["t"] if "t" in s.fields.columns else [])
    weights = s.variable(names[1]).select(*on, "k", F.col("e").alias("w"))
    total = _summed(weights.withColumnRenamed("w", "e"), on).withColumnRenamed("e", "total")
    met = s.variable(names[0]).join(weights, [*on, "k"]).join(total, on)
    share = F.zip_with(F.zip_with("e", "w", lambda x, w: x * w), "total", lambda x, t: x / F.nullif(t, F.lit(0.0)))
    kept = F.transform(share, lambda x: F.when((x > 0) & (x < float("inf")), x).otherwise(0.0))
    return s.at_surface(obs, s.without_offset(_summed(met.withColumn("e", kept), on)))


#: (is surface, tag): function of observations, source and variables that gives id, he
REGISTRY: dict[tuple[bool, str], Callable[[DataFrame, Source, list[str]], DataFrame]] = {
    (True, "standard"): surface_standard,
    (True, "biased"): surface_biased,
    (False, "standard"): depth_standard,
    (False, "lowmem"): depth_standard,
    (False, "wsurfbias"): depth_with_surface_bias,
    (True, "vertsum"): vertical_sum,
    (False, "vertsum"): vertical_sum,
    (True, "vertwavg"): vertical_mean,
    (False, "vertwavg"): vertical_mean,
}


def ensemble_observations(obs: DataFrame, types: list[dict], sources: dict[str, Source], skip_bad: bool = False) -> DataFrame:
    """obs with he, the members at each of them, by the function of its type.

    types: name, surface, function, variables, grid. An observation without a finite forecast of at most MAX_VALUE gets
    status BADFC, where these are to be skipped, and otherwise is an error.
    """
    out = None
    for t in types:
        mine = obs.where(F.col("type") == t["name"])
        he = REGISTRY[t["surface"], t["function"]](mine, sources[t["grid"]], t["variables"])
        out = he if out is None else out.unionByName(he)
    met = obs.join(out, "id", "left")
    bad = F.col("he").isNull() | F.exists("he", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > M.MAX_VALUE))
    if skip_bad:
        return met.withColumn("status", F.when(bad, "BADFC").otherwise(F.col("status")))
    return met.withColumn("he", F.when(bad, F.raise_error(F.concat(F.lit("no sound forecast at observation "), F.col("id").cast("string")))).otherwise(F.col("he")))


def recentred(he: Column, background: Column) -> Column:
    """Members of an anomalies-only ensemble, around the background's value."""
    mean = M.mean_of(he)
    return F.transform(he, lambda x: x - mean + background)


def hybrid(e: Column, dynamic: int, members: int, gamma: float, centre: bool) -> Column:
    """Dynamic members and static anomalies scaled so that their joint covariance is the sum of both.

    centre: static members are first taken around their own mean, as in observation space; in state space they are
    anomalies already.
    """
    kd = ((members - 1) / (dynamic - 1)) ** 0.5 if dynamic > 1 else 0.0
    ks = (gamma * (members - 1) / (members - dynamic - 1)) ** 0.5
    moving, static = F.slice(e, 1, dynamic), F.slice(e, dynamic + 1, members - dynamic)
    mean = M.mean_of(moving)
    own = M.mean_of(static) if centre else F.lit(0.0)
    return F.concat(F.transform(moving, lambda x: (x - mean) * kd + mean), F.transform(static, lambda x: (x - own) * ks + mean))


def forecast(obs: DataFrame, dynamic: int | None = None, suffix: str = "f") -> DataFrame:
    """hx, std and inn (with a suffix) of he: mean of the dynamic members, spread of all around it (n - 1), innovation."""
    moving = F.col("he") if dynamic is None else F.slice("he", 1, dynamic)
    out = obs.withColumn(f"hx_{suffix}", M.mean_of(moving))
    spread = F.sqrt(M.square_sum(M.anomalies(F.col("he"), F.col(f"hx_{suffix}"))) / (F.size("he") - 1))
    return out.withColumns({f"std_{suffix}": spread, f"inn_{suffix}": F.col("value") - F.col(f"hx_{suffix}")})


def standardised(obs: DataFrame, rfactor: Column | float = 1.0) -> DataFrame:
    """obs with s and d: anomalies and innovation over the error and the root of the members less one."""
    rfactor = rfactor if isinstance(rfactor, Column) else F.lit(float(rfactor))
    scale = F.col("estd") * F.sqrt(rfactor) * F.sqrt(F.size("he") - F.lit(1.0))
    return obs.withColumns({"s": F.transform("he", lambda x: (x - F.col("hx_f")) / scale), "d": F.col("inn_f") / scale})
