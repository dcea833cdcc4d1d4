"""A corpus from raw documents to token counts: five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and keeps the columns of documents, but for the last one.
Null and empty texts: the first stage rejects them, as it does all texts without a letter.  Empty tables
pass as empty tables; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronofold.llm import bpe, decontamination, language_id, line_dedup, near_duplicates
from chronofold.llm.session import bound_batches
from chronofold.runtime import Work

#: The stages' decisions follow learned weights, signatures and alignments, which SQL cannot state.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go."""
    bound_batches(spark)
    model = language_id.fit(docs)
    found = language_id.identify(docs, model, "__llm_lang", "__llm_score")
    return found.where(F.col("__llm_lang") != language_id.UNDETERMINED).drop("__llm_lang", "__llm_score")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that near-equal earlier lines hold; n_chars follows."""
    bound_batches(spark)
    out = line_dedup.dedup_lines(docs, widths=line_dedup.BY_LENGTH)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    bound_batches(spark)
    return near_duplicates.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    bound_batches(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text they decode to."""
    bound_batches(spark)
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(docs, path)


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("benchmark", decontaminate),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, work.cut(stage(spark, docs, sf_dir), name)
        work.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
