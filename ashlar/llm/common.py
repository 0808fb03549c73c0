"""What the operators of this subpackage share beside the library's own tables and joins."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.tables import cut, discard, filesystem, shared_dir, skew_join  # noqa: F401  used from here

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One whole table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; null stays null."""
    return F.translate(text, UPPER, LOWER)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While this holds, Python gets so many rows at a time: both sides of the pipe hold a batch of whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """While this holds, what a write has shuffled goes when it ends. Else it stays until the driver happens to collect its garbage, beside all that later steps shuffle."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


def give_back() -> None:
    """Returns freed memory to the system: a worker that waits for its next batch or task shares an executor's memory with others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to ask for
        pass


def tidy(run: Callable) -> Callable:
    """A function over batches that gives its memory back when its task's last batch is done: a worker outlives its tasks."""

    @functools.wraps(run)
    def whole(batches):
        yield from run(batches)
        give_back()

    return whole
