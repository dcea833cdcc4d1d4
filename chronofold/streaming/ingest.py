"""Resumable ingest of dump parts as a stream."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from chronofold.operators.extract import IngestRules, extract_entries, judge_pages
from chronofold.schema import CATEGORIES
from chronofold.sources.dump import stream_pages


def _counts(judged: DataFrame) -> list:
    kept = F.col("reject_reason").isNull()
    return [F.count(F.lit(1)).alias("considered"), F.count(F.when(kept, 1)).alias("collected"),
            F.count(F.when(~kept, 1)).alias("rejected"),
            *[F.count(F.when(kept & (F.col("category") == c), 1)).alias(c) for c in CATEGORIES]]


def start_ingest(spark: SparkSession, dump: str, out: str, checkpoint: str, rules: IngestRules = IngestRules(),
                 files_per_batch: int = 1) -> StreamingQuery:
    """Turn every dump part not yet done into entries under `out`/entries and one row
    of counts under `out`/progress, then stop.  Each run and its rules are noted
    under `out`/runs.

    Started again, it goes on after the last finished part.  A batch that was cut
    short is written again over its own folder, so no row comes twice.  The counts are also observed on the stream, as "ingest", for
    listeners such as metrics.ProgressTable.
    """
    judged = judge_pages(stream_pages(spark, dump, files_per_batch), rules)
    judged = judged.observe("ingest", *_counts(judged))

    def one_batch(judged: DataFrame, batch: int) -> None:
        seen = Observation(f"ingest-{batch}")
        judged = judged.observe(seen, *_counts(judged))
        extract_entries(judged).write.mode("overwrite").parquet(f"{out}/entries/batch={batch}")
        n = seen.get
        row = spark.range(1).select(*[F.lit(n[k]).cast("long").alias(k) for k in n], F.current_timestamp().alias("at"))
        row.write.mode("overwrite").parquet(f"{out}/progress/batch={batch}")

    run = spark.range(1).select(F.lit(json.dumps(asdict(rules))).alias("rules"), F.current_timestamp().alias("started_at"))
    run.write.mode("append").parquet(f"{out}/runs")
    return (judged.writeStream.foreachBatch(one_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def progress_totals(spark: SparkSession, out: str) -> DataFrame:
    """Counts over all finished parts."""
    p = spark.read.parquet(f"{out}/progress")
    names = ["considered", "collected", "rejected", *CATEGORIES]
    return p.agg(F.count(F.lit(1)).alias("parts"), *[F.sum(n).alias(n) for n in names]).withColumn(
        "percent_kept", F.col("collected") * 100 / F.nullif("considered", F.lit(0)))
