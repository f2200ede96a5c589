"""Python workers that keep little memory: small Arrow batches, and what a task has used goes back when it ends.

A worker process serves one task after another, so what its allocators hold
back after the largest one would add up over the steps of a job.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch between the JVM and Python, where the session names no number.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches of a session that has no bound of its own."""
    if spark.conf.get(_KEY, None) is None:
        spark.conf.set(_KEY, str(BATCH_BYTES))


def give_back() -> None:
    """Return free memory of Arrow and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy[T](run: Callable[[Iterator[T]], Iterator]) -> Callable[[Iterator[T]], Iterator]:
    """``run`` over a task's batches, then :func:`give_back`."""

    def whole(batches: Iterator[T]) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` in small batches and tidily."""
    small_batches(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)
