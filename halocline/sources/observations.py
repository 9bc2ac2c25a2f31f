"""Observation tables from the columns of raw tables; one row is one observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SURFACE = ("view", "click", "error")
DAY = 86400e6


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Scattered observations from the events table."""
    raw = spark.read.parquet(f"{folder}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return raw.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.lit("EVENTS").alias("product"), F.concat(F.lit("I"), (F.col("user_id") % 7).cast("string")).alias("instrument"),
        F.floor(us / F.lit(DAY)).cast("long").alias("file"), (F.col("user_id") % 11).cast("long").alias("batch"), "value",
        (F.lit(0.5) + (F.col("k") % 10) * F.lit(0.1)).alias("estd"), ((F.col("user_id") * 37 + F.col("k") * 3) % 360 + F.lit(0.5)).alias("lon"), (F.col("k") * F.lit(1.6) - F.lit(79.2)).alias("lat"),
        F.when(F.col("event_type").isin(*SURFACE), F.lit(0.0)).otherwise((F.col("event_id") % 40) * F.lit(25.0)).alias("depth"),
        (us / F.lit(DAY) - F.lit(19738.0)).alias("time"),
    )


def scattered(raw: DataFrame, value: str, *, lon: str = "lon", lat: str = "lat", time: str = "time", depth: Column | None = None, std: str | None = None, error_std: str | None = None, flags: dict[str, list[int]] | None = None, shift: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Points with their errors: rows without a value or with a flag that isn't allowed go; the larger error counts."""
    rows = raw.where(F.col(value).isNotNull() & ~F.isnan(value))
    for name, allowed in (flags or {}).items():
        rows = rows.where(F.col(name).isin(allowed))
    errors = [F.col(c).cast("double") for c in (std, error_std) if c]
    estd = F.greatest(*errors) if len(errors) == 2 else errors[0] if errors else F.lit(None).cast("double")
    return rows.select("*", (F.col(value) * scale + shift).alias("obs_value"), F.col(lon).alias("obs_lon"), F.col(lat).alias("obs_lat"), F.col(time).alias("obs_time"), (depth if depth is not None else F.lit(None).cast("double")).alias("obs_depth"), estd.alias("obs_estd"))


def profiles(rows: DataFrame, values: str, depths: str, flags: str | None = None, good: int = 1, exclude_instruments: list[str] | None = None) -> DataFrame:
    """A row for each good level of arrays of values and depths; a profile's id serves as its batch."""
    out = rows if not exclude_instruments else rows.where(~F.col("instrument").isin(exclude_instruments))
    zipped = F.arrays_zip(F.col(values).alias("v"), F.col(depths).alias("z"), *([F.col(flags).alias("q")] if flags else []))
    out = out.select("*", F.posexplode(zipped).alias("level", "x")).where("x.v is not null and x.z is not null")
    if flags:
        out = out.where(F.col("x.q") == good)
    return out.select(*rows.columns, "level", F.col("x.v").alias("value"), F.col("x.z").alias("depth"))


def gridded(rows: DataFrame, values: str, depth: float = 0.0) -> DataFrame:
    """A row for each defined cell of two-dimensional arrays."""
    out = rows.select(*[c for c in rows.columns if c != values], F.posexplode(values).alias("j", "row"))
    out = out.select(*[c for c in out.columns if c != "row"], F.posexplode("row").alias("i", "value"))
    return out.where("value is not null").withColumn("depth", F.lit(depth))
