"""Settings of the corpus operators' sessions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Rows of an Arrow batch: of texts of 100 KB a batch is 100 MB, not a gigabyte.
BATCH_ROWS = 1000
#: Rows of an Arrow batch of a few numbers each.
NARROW_BATCH_ROWS = 65_536


def bound_batches(spark: SparkSession) -> None:
    """Keep batches that go to Python workers small, as documents may be long.

    Tasks with two Python steps hold two batches on each side, and idle workers keep
    what they once took.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@contextmanager
def long_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside, not only planned, sends narrow rows to Python in long batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(NARROW_BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)
