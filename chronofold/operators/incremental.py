"""Refreshing stored records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chronofold.runtime import broadcast_if_small, cut


def to_fetch(slim: DataFrame, cached: DataFrame) -> DataFrame:
    """Ids (id, last_updated) that the cache lacks or holds in an older state."""
    have = cached.select("id", F.col("last_updated").alias("have"))
    return slim.join(have, "id", "left").filter(F.col("have").isNull() | (F.col("have") < F.col("last_updated"))).drop("have")


def resolve(slim: DataFrame, cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """Full records for the slim list: the fetched copy where one came, else the
    cached one; an id with neither is dropped.  Sort by the slim list's own order."""
    new = fetched.join(to_fetch(slim, cached).select("id"), "id", "left_semi").withColumn("__new", F.lit(1))
    both = new.unionByName(cached.withColumn("__new", F.lit(0)))
    return upsert(both.join(slim.select("id"), "id", "left_semi"), ["id"], ["__new"]).drop("__new")


def upsert(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row per key.  A partial maximum, so a key with very many versions
    is cut down before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(latest.alias("r")).select(*keys, "r.*").select(*rows.columns)


def record_progress(progress: DataFrame, done: DataFrame) -> DataFrame:
    """Finished chunks (category, low, high, n, completed_at), the latest record of each."""
    return upsert(progress.unionByName(done), ["category", "low", "high"], ["completed_at"])


def chunks_left(chunks: DataFrame, progress: DataFrame) -> DataFrame:
    return chunks.join(progress.select("category", "low", "high"), ["category", "low", "high"], "left_anti")


def records_of(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Records whose category and year lie in one of the (disjoint) chunks, with the chunk's bounds.

    Both sides meet on buckets of the largest power of two within a chunk's width, so a chunk is three rows at most however
    many years it has; a record has a row for each width there is, of which one is kept.
    """
    low, high = F.col("low").cast("long"), F.col("high").cast("long")
    level = F.length(F.bin(high - low + 1)) - 1
    bucket = lambda year, n: F.call_function("shiftright", year.cast("long"), n)
    spans = cut(chunks.filter("low <= high").select("category", "low", "high", level.alias("__level"), F.explode(F.sequence(bucket(low, level), bucket(high, level))).alias("__bucket")), "spans")
    levels = [r[0] for r in spans.select("__level").distinct().collect()]  # 64 at most
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("__level"), bucket(F.col("year"), F.lit(n)).alias("__bucket")) for n in levels or [0]])).alias("__at")
    met = records.select("*", at).select(*records.columns, "__at.*").join(broadcast_if_small(spans), ["category", "__level", "__bucket"])
    return met.filter(F.col("year").between(F.col("low"), F.col("high"))).select(*records.columns, "low", "high")


def load_chunks(records: DataFrame, chunks: DataFrame, progress: DataFrame, path: str) -> DataFrame:
    """Load the chunks not yet recorded, all in one job, each into its own partition
    (loading one again replaces it), and return the new progress table.

    Only the chunks just written are counted: the partition columns prune the rest.
    """
    left = cut(chunks_left(chunks, progress), "chunks-left")
    part, keys = records_of(records, left), ["category", "low", "high"]
    part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    stored = records.sparkSession.read.schema(part.schema).parquet(path)
    loaded = stored.join(broadcast_if_small(left.select(*keys)), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    done = left.select(*keys).join(loaded, keys, "left").select(
        "category", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.current_timestamp().alias("completed_at"))
    return record_progress(progress, done)
