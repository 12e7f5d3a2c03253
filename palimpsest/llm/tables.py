"""Joins with a side whose size is known, and batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: with texts of some thousand bytes, a batch is a few megabytes in the JVM and in Python.
BATCH_ROWS = "1000"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(spark: SparkSession, rows: str = BATCH_ROWS) -> None:
    """Small Arrow batches, where the session has Spark's default of 10,000 rows or what this has set before. Results don't depend on it."""
    if spark.conf.get(_ROWS) in ("10000", BATCH_ROWS):
        spark.conf.set(_ROWS, rows)


@contextmanager
def wide_rows(spark: SparkSession, rows: int = 4) -> Iterator[None]:
    """Arrow batches of few rows for what is written inside: a batch of packed rows lies outside the heap, in the JVM and in Python."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def few(df: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast if it is counted to have at most ``most`` rows; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= most else df
