"""Super-observations of a stream of observations, in windows of event time.

A cycle's window is half open, and rows that come after the watermark belong to no cycle any more, as those outside the
observation window of a batch run. State is bounded by the cells of the windows that are still open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slots(ts: str, step: str, centred: bool = True, half: str | None = None) -> Column:
    """The time slot of a timestamp; a centred slot begins half a step (given as an interval) before its time."""
    return F.window(ts, step, startTime=half) if centred and half else F.window(ts, step)


def assimilation_windows(obs: DataFrame, keys: list[str], cycle: str, late: str, ts: str = "ts", slot: Column | None = None) -> DataFrame:
    """Inverse-variance means of value, lon, lat, depth and time by keys in each cycle's window; in append mode, once each.

    obs: a streaming (or static) table with value, estd and status; only good rows count. slot: asynchronous slots within
    a cycle, instead of one for all of it.
    """
    w = 1 / (F.col("estd") * F.col("estd"))
    mean = lambda c: (F.sum(F.col(c) * w) / F.sum(w)).alias(c)
    good = obs.where(F.col("status") == "OK").withWatermark(ts, late)
    window = (F.window(ts, cycle) if slot is None else slot).alias("window")
    names = [c for c in ("value", "lon", "lat", "depth") if c in obs.columns]
    out = good.groupBy(window, *keys).agg(F.min("id").alias("id"), *[mean(c) for c in names], F.sqrt(1 / F.sum(w)).alias("estd"), F.count("*").alias("nobs"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "id", *names, "estd", "nobs")


def to_cycles(stream: DataFrame, path: str, checkpoint: str, analyse: Callable[[DataFrame, int], DataFrame] | None = None):
    """Starts a query that hands each closed batch of super-observations to an analysis and keeps its result by cycle.

    What a cycle writes is replaced as a whole if it is written again after a failure, so each is there once; the next
    cycle's forecast may start from it.
    """

    def one(batch: DataFrame, number: int) -> None:
        out = batch if analyse is None else analyse(batch, number)
        out.write.mode("overwrite").parquet(f"{path}/cycle={number}")

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start()
