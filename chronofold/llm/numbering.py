"""Gapless numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from chronofold.llm.linking import NARROW_ROWS
from chronofold.runtime import Work, broadcast_if_small

#: Rows of a chunk, on average.
CHUNK = 20_000


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, work: Work) -> DataFrame:
    """df with `name`: 0, 1, ... within each group.

    Groups are cut into chunks by a hash of the order columns, chunks are counted, and rows
    are numbered within their chunk, so a group is never one task; rows are in
    chunk order, then in that of `order`.
    """
    chunks = max(1, df.count() // CHUNK)
    df = df.withColumn("__chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    keys = [*group, "__chunk"]
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*group).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = work.cut(counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"), "chunks")
    inner = W.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__i", F.row_number().over(inner) - 1).join(broadcast_if_small(counts, NARROW_ROWS), keys)
    return out.withColumn(name, F.col("__i") + F.col("__before")).drop("__i", "__before", "__chunk")
