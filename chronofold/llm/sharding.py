"""Sharding by longest processing time: groups of equal texts, largest first, to the least-loaded shard."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F

from chronofold.llm.linking import NARROW_ROWS
from chronofold.llm.numbering import numbered
from chronofold.runtime import Work, broadcast_if_small

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Leading bits of a group's size that make its class: sizes of a class differ by less than 1 in 2**14.
CLASS_BITS = 15
SHARDS = 40


def size_class(size):
    """Sizes below 2^CLASS_BITS are classes of their own; larger ones share their leading bits."""
    low = F.greatest(F.length(F.bin(size)) - CLASS_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, low), low)


def deal(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(class, first, end, shard): which of a class's groups, numbered from 0, go to which shard.

    classes: (class, groups, bytes).  Classes come largest first.  A group goes to the
    least-loaded shard, the lower number among equals.  While a class has many groups
    the rounds in which every shard takes one are dealt at once; the heap gives the
    same counts one by one.
    """
    loads = [(0.0, s) for s in range(shards)]
    heapq.heapify(loads)
    out = []
    for key, groups, total in sorted(classes, reverse=True):
        each, at, takes = total / groups, 0, dict.fromkeys(range(shards), 0)
        if groups > 4 * shards:
            # The level that the loads reach together, a little below what the groups fill.
            lo, hi = min(loads)[0], max(loads)[0] + each * groups
            for _ in range(60):
                level = (lo + hi) / 2
                if sum(max(0, int((level - load) / each)) for load, _ in loads) <= groups - shards:
                    lo = level
                else:
                    hi = level
            for load, s in loads:
                takes[s] = max(0, int((lo - load) / each))
            loads = [(load + takes[s] * each, s) for load, s in loads]
            heapq.heapify(loads)
        for _ in range(groups - sum(takes.values())):
            load, s = heapq.heappop(loads)
            takes[s] += 1
            heapq.heappush(loads, (load + each, s))
        for s, n in takes.items():
            if n:
                out.append((key, at, at + n, s))
                at += n
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): all rows, equal texts in one shard.

    The law is `bytes`: sizes (UTF-8 bytes of the text plus 16) are nearly equal over the shards, as
    far as one group of equal texts does not outweigh them.  slot numbers a
    shard's rows from 0 without a gap.  Null texts have no bytes and are one group, apart from
    empty ones; text_crc32 of both is 0.  Null doc_ids and repeated rows are rows like others.
    grown_shard is null, as this law moves rows when a shard is added.  An
    empty table gives no rows.

    Groups are weighed with map-side partial sums.  Only the table of size
    classes comes to the driver: 2^15 classes below 32 KB and 2^14 for each doubling, under
    a million for any input.  Within a class the groups are numbered in chunks.
    """
    spark = docs.sparkSession
    work = Work(spark, "shard")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
                       F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
                       F.col("text").isNull().alias("none"), F.xxhash64("text").alias("h"))
    rows = work.cut(rows, "rows")
    key = ["h", "size", "text_crc32", "none"]
    groups = rows.groupBy(*key).agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    groups = work.cut(groups.withColumn("class", size_class(F.col("total"))), "groups")
    classes = [tuple(r) for r in groups.groupBy("class").agg(F.count("*"), F.sum("total")).toLocalIterator()]
    plan = spark.createDataFrame(deal(classes, shards), "class long, first long, end long, shard int")
    groups = numbered(groups, ["class"], ["h", "size", "text_crc32", "none"], "rank", work)
    plan = broadcast_if_small(plan, NARROW_ROWS)
    placed = groups.join(plan, "class").where("rank >= first and rank < end").select(*key, "shard")
    placed = work.cut(placed, "placed")
    dealt = rows.join(broadcast_if_small(placed, NARROW_ROWS), key)
    out = numbered(dealt, ["shard"], ["doc_id", "h"], "slot", work)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
