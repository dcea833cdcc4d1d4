"""Samples of a dump and finding pages in it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from chronofold.operators.scans import Running, ordinals, running
from chronofold.runtime import broadcast_if_small, cut

# Bytes of a dump file per block of the next-offset scan.
OFFSET_BLOCK = 1 << 26


def every_nth(df: DataFrame, stream: str, stride: int, first: int = 0) -> DataFrame:
    """Rows of every stride-th stream from the first on."""
    s = F.col(stream)
    return df.filter((s >= first) & ((s - first) % stride == 0))


def sample_until(df: DataFrame, stream: str, collect: Callable[[DataFrame], DataFrame], stride: int,
                 target: int, max_restarts: int = 2) -> DataFrame:
    """Collect from every stride-th stream; while under target, halve the stride,
    start one stream later and go again.  Adds `pass`; passes may share streams.

    Each pass runs once: it is written out, and what was written is counted.
    """
    out, got, first = None, 0, 0
    for n in range(max_restarts + 1):
        part = cut(collect(every_nth(df, stream, stride, first)).withColumn("pass", F.lit(n)), "pass")
        out = part if out is None else out.unionByName(part)
        got += part.count()
        if got >= target:
            break
        stride, first = -(-stride // 2), first + 1
    return out


def stop_after_considering(df: DataFrame, stream: str, most: int, block: int = 10_000) -> DataFrame:
    """Whole streams in order until `most` rows were seen; the stream that reaches it
    is the last one taken."""
    n = df.groupBy(stream).agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", F.floor(F.col(stream) / block))
    n = running(n, [], "__b", [stream], {"__before": Running("sum", F.col("__n"), False)})
    return df.join(n.filter(F.col("__before") < most).select(stream), stream, "left_semi")


def stop_after_collecting(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first `most` rows in order."""
    return df.orderBy(*order).limit(most)


def next_offsets(index: DataFrame, file: str = "file") -> DataFrame:
    """(file, offset, next_offset, stream): streams of each dump file with the offset
    of the following one, null for the last."""
    o = index.select(file, "offset").distinct().withColumn("__b", F.floor(F.col("offset") / OFFSET_BLOCK))
    out = running(o, [file], "__b", ["offset"], {"next_offset": Running("next", F.col("offset"), False),
                                                 "stream": Running("sum", F.lit(1), False)})
    return out.select(file, "offset", "next_offset", "stream")


def find_titles(titles: DataFrame, index: DataFrame, file: str = "file") -> DataFrame:
    """(title, file, offset, next_offset): where in the dump each title lies."""
    at = index.join(broadcast_if_small(titles.select("title")), "title", "left_semi").select("title", file, "offset")
    return at.join(next_offsets(index, file), [file, "offset"]).select("title", file, "offset", "next_offset")


def spread_sample(df: DataFrame, group: str, pos: str, n: int, block: int = 100_000) -> DataFrame:
    """About n rows, spread evenly over each group: every step-th row of a group,
    step = its size / its share, at most the share; groups in order of first row."""
    ranked = ordinals(df, [group], F.floor(F.col(pos) / block), [pos], "__i")
    sizes = cut(df.groupBy(group).agg(F.count(F.lit(1)).alias("__size"), F.min(pos).alias("__first")), "sizes")
    share = F.greatest(F.lit(1), F.ceil(F.lit(n) / F.lit(max(1, sizes.count()))))
    sizes = sizes.withColumn("__step", F.greatest(F.lit(1), F.floor(F.col("__size") / share)))
    kept = ranked.join(broadcast_if_small(sizes), group).filter(
        (F.col("__i") % F.col("__step") == 0) & (F.col("__i") / F.col("__step") < share))
    return kept.orderBy("__first", pos).limit(n).select(*df.columns)
