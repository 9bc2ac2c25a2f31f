"""Ensemble diagnostics, reports on innovations, and point logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maths as M
from . import spatial

LAYERS = (("0-50", 0.0, 50.0), ("50-500", 50.0, 500.0), ("500-9999", 500.0, 9999.0))


def field_spread(e: Column) -> Column:
    """Root of the members' variance (n); 0 where their mean is out of bounds."""
    mean = M.mean_of(e)
    variance = M.square_sum(e) / F.size(e) - mean * mean
    return F.when(F.abs(mean) <= M.MAX_VALUE, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(0.0)


def finite(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c).otherwise(0.0)


def _anomalies(fields: DataFrame, name: str) -> DataFrame:
    return fields.withColumn(name, M.anomalies(F.col("e"), M.mean_of(F.col("e")))).drop("e")


def vertical_correlation(fields: DataFrame, surface: int = 0) -> DataFrame:
    """fields (k, j, i, e) with corr, each layer's correlation with its column's surface layer; 0 where there is none."""
    own = _anomalies(fields, "p")
    top = own.where(F.col("k") == surface).select("j", "i", F.col("p").alias("q"))
    r = M.dot(F.col("p"), F.col("q")) / F.nullif(F.sqrt(M.square_sum(F.col("p")) * M.square_sum(F.col("q"))), F.lit(0.0))
    return own.join(top, ["j", "i"]).withColumn("corr", finite(r)).drop("p", "q")


def with_given(fields: DataFrame, given: DataFrame, on: list[str]) -> DataFrame:
    """fields (e) with corr, cov (n - 1) and sens (covariance over the given variance) with a given field's members."""
    own = _anomalies(fields, "p").join(_anomalies(given, "q"), on)
    pq, qq = M.dot(F.col("p"), F.col("q")), M.square_sum(F.col("q"))
    corr = pq / F.nullif(F.sqrt(M.square_sum(F.col("p")) * qq), F.lit(0.0))
    return own.withColumns({"corr": finite(corr), "cov": pq / (F.size("p") - 1), "sens": finite(pq / F.nullif(qq, F.lit(0.0)))}).drop("p", "q")


def in_regions(obs: DataFrame, regions: DataFrame) -> DataFrame:
    """obs once for each region (region, west, east, south, north) that holds it; longitudes are cyclic."""
    inside = F.col("lat").between(F.col("south"), F.col("north")) & M.cyclic(F.col("lon"), F.col("west"), F.col("east"))
    return obs.join(F.broadcast(regions), inside).drop("west", "east", "south", "north")  # the few regions of a system


def observation_stats(obs: DataFrame, regions: DataFrame, layers: DataFrame | None = None, step: float = 1.0, rmsd: bool = False) -> DataFrame:
    """The report: by region and type, and each also by slot, by instrument and by depth, in one aggregation.

    Mean absolute (or root mean square) and mean innovations, and spreads, before (f) and, if there are any, after (a).
    """
    met = in_regions(obs, regions).withColumn("slot", M.slot(F.col("time"), step))
    zints = F.expr("cast(null as array<string>)")
    if layers is not None:
        held = [F.when((F.col("depth") >= z1) & (F.col("depth") < z2), F.lit(n)) for n, z1, z2 in layers.collect()]  # the few intervals of a system
        zints = F.filter(F.array(*held), lambda x: x.isNotNull())
    # a row once as itself, and once for each depth interval that it is in
    parts = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(zints, F.array().cast("array<string>")))
    met = met.withColumn("layer", F.explode(parts))
    size = (lambda c: F.sqrt(F.avg(c * c))) if rmsd else (lambda c: F.avg(F.abs(c)))
    aggregates = [F.count("*").alias("n")]
    for x in ("f", "a"):
        if f"inn_{x}" in obs.columns:
            inn = F.col(f"inn_{x}")
            aggregates += [size(inn).alias(f"dev_{x}"), F.avg(inn).alias(f"inn_{x}"), F.avg(f"std_{x}").alias(f"std_{x}")]
    kind = F.when(F.col("layer").isNotNull(), F.array(F.lit("depth"))).otherwise(F.array(F.lit("all"), F.lit("slot"), F.lit("instrument")))
    key = F.when(F.col("kind") == "slot", F.col("slot").cast("string")).when(F.col("kind") == "instrument", F.col("instrument")).when(F.col("kind") == "depth", F.col("layer"))
    return met.withColumn("kind", F.explode(kind)).withColumn("part", key).groupBy("region", "type", "kind", "part").agg(*aggregates)


def point_log(obs: DataFrame, place: DataFrame, radius: float | dict[str, float], coeff: Column) -> DataFrame:
    """All local observations of a place (node, lon, lat), of any domain, with distance d and coefficient."""
    return spatial.within(spatial.with_xyz(place), obs, radius).withColumn("coeff", coeff)


def state_at(place: DataFrame, fields: DataFrame, nodes: DataFrame, ni: int, nj: int, periodic: bool = True) -> DataFrame:
    """node, var, k, e: the members of every layer at places (node, fi, fj), from their wet corners."""
    at = spatial.corners(place.select("node", "fi", "fj"), ni, nj, periodic).where("weight > 0")
    wet = at.join(nodes.select("j", "i", "numlevels"), ["j", "i"]).join(fields, ["j", "i"]).where("numlevels > k")
    key = F.struct("node", "var", "k")
    return spatial.mean_members(wet.select(key.alias("id"), F.col("weight").alias("w"), "e")).select("id.*", F.col("he").alias("e"))


def single_observation(spark, lon: float, lat: float, depth: float, kind: str, innovation: float, estd: float) -> DataFrame:
    """The one observation of a single-observation run: its innovation is given, whatever the forecast there."""
    schema = "id long, type string, lon double, lat double, depth double, inn_f double, estd double, time double, status string"
    return spark.createDataFrame([(0, kind, lon, lat, depth, innovation, estd, 0.0, "OK")], schema)
