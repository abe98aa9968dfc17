"""What operators on long texts do to keep the memory of executors and their workers bounded."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import SparkSession

_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Of rows that hold a whole text, or all its shingles, so many go to a worker at once.
TEXT_ROWS = 1000

T = TypeVar("T")


@contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Jobs that run inside send batches of no more than so many rows between the JVM and its workers:
    both sides hold a batch as a whole, outside the heap."""
    before = spark.conf.get(_ROWS_SETTING)
    spark.conf.set(_ROWS_SETTING, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_SETTING, before)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """Hands free pages back to the system, where the C library can."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Free memory of this worker goes back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(results: Iterator[T], *forget: Callable[[], None]) -> Iterator[T]:
    """The results of a task; after the last one caches are forgotten and free memory is given back."""
    try:
        yield from results
    finally:
        for cache in forget:
            cache()
        give_back()
