"""Page dumps and their index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chronofold.functions.text import decode_entities
from chronofold.runtime import keep_if

PAGE_END = "</page>"


def parse_pages(raw: DataFrame) -> DataFrame:
    """(title, wikitext) of the article pages in text cut at page ends.

    A page lacking title or text is left out, as are other name spaces; a page
    that names none counts as an article.
    """
    mark = "<page>"
    df = raw.filter(F.contains("value", F.lit(mark))).select(
        F.substr("value", F.position(F.lit(mark), "value") + len(mark)).alias("page"))
    # Page text is long: its ends are found as plain strings, not by a pattern that is tried at every character.
    df = df.select("page", F.position(F.lit("<text"), "page").alias("tag"))
    df = df.select("page", F.position(F.lit(">"), "page", "tag").alias("open"))
    df = df.select("page", "open", F.position(F.lit("</text>"), "page", F.col("open") + 1).alias("close"))
    df = df.select(
        F.regexp_like("page", F.lit("<title>[^<]*</title>")).alias("has_title"),
        F.regexp_extract("page", "<title>([^<]*)</title>", 1).alias("title"),
        ((F.col("open") > 0) & (F.col("close") > 0)).alias("has_text"),
        F.substr("page", F.col("open") + 1, F.col("close") - F.col("open") - 1).alias("text"),
        F.regexp_extract("page", r"<ns>(\d+)</ns>", 1).alias("ns"))
    article = F.coalesce(F.col("ns").try_cast("int"), F.lit(0)) == 0
    df = keep_if(df, F.col("has_title") & F.col("has_text") & article)
    return df.select(decode_entities(F.col("title")).alias("title"), decode_entities(F.col("text")).alias("wikitext"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a dump.  Cutting at the page end lets one concatenated bz2 file be
    read by many tasks."""
    return parse_pages(spark.read.option("lineSep", PAGE_END).text(path))


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The same over a folder to which dump parts are added."""
    raw = spark.readStream.option("lineSep", PAGE_END).option("maxFilesPerTrigger", files_per_batch).text(path)
    return parse_pages(raw)


def index_columns(line: Column) -> list[Column]:
    p = r"^(\d+):(\d+):(.+)\z"
    return [F.regexp_extract(line, p, 1).try_cast("long").alias("offset"),
            F.regexp_extract(line, p, 2).try_cast("long").alias("article_id"), F.regexp_extract(line, p, 3).alias("title")]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, article_id, title) of 'offset:id:title' lines; a title may hold colons."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    return lines.select("file", *index_columns(F.col("value"))).filter("offset IS NOT NULL AND article_id IS NOT NULL")


def stream_offsets(index: DataFrame) -> DataFrame:
    return index.select("offset").distinct().orderBy("offset")
