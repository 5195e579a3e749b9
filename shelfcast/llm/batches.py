"""Smaller Arrow batches while a table of long texts is computed and stored."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Within, a Python worker gets `rows` rows at a time, so that long texts fit in its memory."""
    before = spark.conf.get(_KEY)
    spark.conf.set(_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_KEY, before)
