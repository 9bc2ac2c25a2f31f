"""Shared plumbing of the corpus operators: inputs, folds and slices of text; written intermediates are those of the engine."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import discard, new_path, shared_folder, written

__all__ = ["arrow_batches", "bind", "discard", "fold", "lean", "new_path", "shared_folder", "slices", "table", "written"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: bytes of an Arrow batch; without it, only the number of rows is limited in practice, however long their texts are
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, most: str) -> Iterator[None]:
    """What is written meanwhile goes to Python in batches of about most: an executor holds one in its own memory and one in its worker's, for each task."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, most)
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def bind(value: Column, use) -> Column:
    """use(value) with value evaluated once per row, however often use refers to it."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def fold(column: str, folds: int) -> Column:
    """Remainder of the crc32 of an id's decimal text."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which maps a task's batches, and then its memory goes back: the worker stays and its executor's limit counts what it keeps."""

    def freed(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return freed


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = 500_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of the batches with about so many bytes of text in a part, so that long texts don't add up in memory."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = np.cumsum(sizes) // chars if len(sizes) else sizes
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                part = batch.slice(a, b - a)
                yield part, part.column(column).to_pylist()
