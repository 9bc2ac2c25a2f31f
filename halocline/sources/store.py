"""Tables at rest: observations, fields by variable and layer, transforms, and files that match a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELD = "var string, t int, k int, j int, i int, e array<float>"


def write_observations(obs: DataFrame, path: str) -> None:
    obs.write.mode("overwrite").partitionBy("type").parquet(path)


def read_observations(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    """Stored observations; only the folders of the types asked for are read."""
    obs = spark.read.parquet(path)
    return obs.where(F.col("type").isin(types)) if types else obs


def write_fields(fields: DataFrame, path: str, kind: str = "forecast") -> None:
    """Fields by kind (forecast, analysis, increment, ...), variable and layer: a layer is a unit of reading and writing."""
    fields.withColumn("kind", F.lit(kind)).write.mode("append").partitionBy("kind", "var", "k").parquet(path)


def read_field(spark: SparkSession, path: str, var: str, k: int | None = None, kind: str = "forecast", rows: tuple[int, int] | None = None, record: int | None = None) -> DataFrame:
    """A variable, or one layer of it, or some of its rows: partitions are pruned, and rows pushed down to the scan."""
    out = spark.read.parquet(path).where((F.col("kind") == kind) & (F.col("var") == var))
    out = out if k is None else out.where(F.col("k") == k)
    out = out if record is None else out.where(F.col("t") == record)
    return out if rows is None else out.where(F.col("j").between(*rows))


def matching(files: DataFrame, analysis: float, step: float, tolerance: float = 1e-3, at_end: bool = False) -> DataFrame:
    """slot, file, record of records (file, record, time) at analysis time plus whole steps; others are none.

    at_end: a record's time is the end of its slot, not the middle.
    """
    t = (F.col("time") - analysis - (step / 2 if at_end else 0.0)) / step
    slot = F.round(t)
    return files.where(F.abs(t - slot) * step < tolerance).select(slot.cast("int").alias("slot"), "file", "record")


def slots_complete(needed: DataFrame, found: DataFrame) -> DataFrame:
    """Each slot that observations need with its file and record; a slot without one is an error."""
    met = needed.select("slot").distinct().join(found, "slot", "left")
    return met.withColumn("file", F.when(F.col("file").isNull(), F.raise_error(F.concat(F.lit("no record for slot "), F.col("slot").cast("string")))).otherwise(F.col("file")))


def write_report(rows: DataFrame, path: str) -> None:
    """A small report as one text file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
