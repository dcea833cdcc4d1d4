"""Queries for refreshing stored records, in batches and as streams."""

from pyspark.sql import functions as F

from chronofold.operators import facts as K, incremental as I
from chronofold.operators.extract import IngestRules
from chronofold.plans import fixtures as v
from chronofold.plans.pages import NUMBERS
from chronofold.plans.registry import query
from chronofold.runtime import shared_path
from chronofold.streaming import ingest, metrics, refresh


@query("cache_difference", """
SELECT e.id, e.last_updated FROM v_entries e LEFT JOIN v_cache c ON c.id=e.id WHERE c.id IS NULL OR c.last_updated<e.last_updated""", ("v_entries", "v_cache"))
def cache_difference(spark, sf):
    return I.to_fetch(v.entries(spark, sf).select("id", "last_updated"), v.cache(spark, sf))


@query("cache_resolve", """
SELECT e.id, CASE WHEN f.id IS NOT NULL THEN concat('new ',e.title) ELSE c.title END AS title FROM v_entries e LEFT JOIN v_cache c ON c.id=e.id
LEFT JOIN (SELECT e.id FROM v_entries e LEFT JOIN v_cache c ON c.id=e.id WHERE (c.id IS NULL OR c.last_updated<e.last_updated) AND e.id%7<>0) f ON f.id=e.id WHERE f.id IS NOT NULL OR c.id IS NOT NULL""", ("v_entries", "v_cache"))
def cache_resolve(spark, sf):
    """A seventh of the asked-for records does not come back."""
    e = v.entries(spark, sf)
    cached = v.cache(spark, sf).select("id", "title", "last_updated")
    fetched = e.filter("id % 7 <> 0").select("id", F.concat(F.lit("new "), "title").alias("title"), "last_updated")
    return I.resolve(e.select("id", "last_updated"), cached, fetched).select("id", "title")


@query("keyed_upsert", """
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r=1""")
def keyed_upsert(spark, sf):
    e = v.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return I.upsert(e, ["user_id"], ["ts", "event_id"]).drop("ts")


CHUNKS = ("(SELECT DISTINCT category, CAST(k*500-3000 AS INT) AS low, CAST(k*500-2501 AS INT) AS high, k"
          " FROM (SELECT category, CAST(floor((start_year+3000)/500) AS INT) AS k FROM v_entries))")


def chunks(spark, sf):
    """Spans of 500 years of each category; categories share their bounds."""
    k = F.floor((F.col("start_year") + 3000) / 500).cast("int")
    return v.entries(spark, sf).groupBy("category", k.alias("k")).agg(F.count(F.lit(1)).alias("n")).select(
        "category", (F.col("k") * 500 - 3000).alias("low"), (F.col("k") * 500 - 2501).alias("high"), "n", "k")


def recorded(spark, sf):
    c = chunks(spark, sf).filter("k % 3 = 0")
    return c.select("category", "low", "high", F.lit(1).cast("long").alias("n"), F.lit("2020-01-01").cast("timestamp").alias("completed_at"))


@query("progress_record", f"""
SELECT category, low, high, CAST(CASE WHEN k%2=0 THEN 5 ELSE 1 END AS BIGINT) AS n FROM {CHUNKS} WHERE k%3=0 OR k%2=0""", ("v_entries",))
def progress_record(spark, sf):
    done = chunks(spark, sf).filter("k % 2 = 0").select("category", "low", "high", F.lit(5).cast("long").alias("n"), F.lit("2021-01-01").cast("timestamp").alias("completed_at"))
    return I.record_progress(recorded(spark, sf), done).drop("completed_at")


@query("chunks_left", f"SELECT category, low, high FROM {CHUNKS} WHERE k%3<>0", ("v_entries",))
def chunks_left(spark, sf):
    return I.chunks_left(chunks(spark, sf), recorded(spark, sf)).select("category", "low", "high")


@query("chunk_load", f"""
SELECT c.category, c.low, c.high, CASE WHEN k%3=0 THEN 1 ELSE (SELECT count(*) FROM v_entries e WHERE e.category=c.category AND e.start_year BETWEEN c.low AND c.high) END AS n FROM {CHUNKS} c""", ("v_entries",))
def chunk_load(spark, sf):
    """Chunks not yet recorded are loaded in one job; then the progress is whole."""
    records = v.entries(spark, sf).select("id", "title", "category", F.col("start_year").alias("year"))
    return I.load_chunks(records, chunks(spark, sf), recorded(spark, sf), shared_path(spark, "chunks")).drop("completed_at")


@query("stream_refresh", """
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r=1""")
def stream_refresh(spark, sf):
    """The events as a stream of record versions, in several batches."""
    e = v.table(spark, sf, "events")
    parts = shared_path(spark, "event-parts")
    e.repartitionByRange(6, "event_id").write.parquet(parts)
    changes = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(parts)
    changes = changes.withColumn("version", F.struct("ts", "event_id"))
    out = shared_path(spark, "event-table")
    refresh.start_refresh(changes, out, shared_path(spark, "event-checkpoint"), "user_id", "version").awaitTermination()
    return refresh.read_latest(spark, out, "user_id", "version").select("user_id", "event_id", "event_type", "value")


@query("stream_newest", """
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r=1""")
def stream_newest(spark, sf):
    """The same by keyed state: the newest rows come out of the stream's state, not out of the history."""
    e = v.table(spark, sf, "events")
    parts = shared_path(spark, "event-parts")
    e.repartitionByRange(4, F.hash("event_id")).write.parquet(parts)
    changes = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(parts)
    changes = changes.withColumn("version", F.struct("ts", "event_id"))
    checkpoint = shared_path(spark, "event-checkpoint")
    refresh.start_newest(changes, shared_path(spark, "event-table"), checkpoint, "user_id", "version").awaitTermination()
    return refresh.read_newest(spark, checkpoint).select("user_id", "event_id", "event_type", "value")


PARTS = 3


def write_dump(spark, sf):
    """(path, files of a part): the pages as dump files of bz2 page text, in three parts of as many files as the input has splits.

    A bz2 file is written by one task, so their number follows the input."""
    p = v.wiki_pages(spark, sf)
    files = max(spark.sparkContext.defaultParallelism, v.table(spark, sf, "documents").rdd.getNumPartitions())
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    ns = F.when(F.col("page_id") % 10 == 9, "<ns>1</ns>").when(F.col("page_id") % 10 == 8, "").otherwise("<ns>0</ns>")
    xml = F.concat(F.lit("  <page>\n    <title>"), esc(F.col("title")), F.lit("</title>"), ns,
                   F.lit('<revision><text bytes="1" xml:space="preserve">'), esc(F.col("wikitext")), F.lit("</text></revision>\n  </page>"))
    path = shared_path(spark, "dump")
    p.repartitionByRange(PARTS * files, "page_id").select(xml.alias("value")).write.option("compression", "bzip2").text(path)
    return path, files


@query("dump_pages", "SELECT title, md5(wikitext) AS h FROM v_wikitext WHERE page_id%10<>9", ("v_wikitext",))
def dump_pages(spark, sf):
    """Written as bz2 dump files and read back, talk pages left out."""
    from chronofold.sources.dump import read_pages
    return read_pages(spark, write_dump(spark, sf)[0]).select("title", F.md5("wikitext").alias("h"))


def ingest_run(spark, sf, out):
    path, files = write_dump(spark, sf)
    rules = IngestRules(require_points=True, date_before=1850)
    return ingest.start_ingest(spark, path, out, shared_path(spark, "ingest-checkpoint"), rules, files_per_batch=files)


STREAMED = f"SELECT * FROM ({NUMBERS}) WHERE page_id%10<>9 AND t IN (0,1,2,4)"


@query("stream_ingest", f"""
SELECT concat('doc-',CAST(page_id AS STRING)) AS id, category, y0 AS start_year, expr AS start_expr FROM ({STREAMED}) WHERE lat IS NOT NULL AND y0<=1850""")
def stream_ingest(spark, sf):
    """Dump parts as a stream, one per batch, equal to the batch extraction."""
    out = shared_path(spark, "ingest")
    ingest_run(spark, sf, out).awaitTermination()
    return spark.read.parquet(f"{out}/entries").select("id", "category", "start_year", "start_expr")


@query("stream_ingest_counts", f"""
SELECT CAST(3 AS BIGINT) AS parts, count(*) AS considered, count(*) FILTER (ok) AS collected, count(*) FILTER (NOT ok) AS rejected, count(*) FILTER (ok AND category='person') AS person, count(*) FILTER (ok AND category='event') AS event,
 count(*) FILTER (ok)*100/CAST(count(*) AS DOUBLE) AS percent_kept FROM (SELECT *, lat IS NOT NULL AND y0<=1850 AS ok FROM ({STREAMED}))""")
def stream_ingest_counts(spark, sf):
    out = shared_path(spark, "ingest")
    ingest_run(spark, sf, out).awaitTermination()
    return ingest.progress_totals(spark, out).select("parts", "considered", "collected", "rejected", "person", "event", "percent_kept")


@query("stream_metrics", f"""
SELECT CAST(3 AS BIGINT) AS batches, CAST(count(*) AS BIGINT) AS considered, CAST(count(*) FILTER (lat IS NOT NULL AND y0<=1850) AS BIGINT) AS collected, CAST(0 AS BIGINT) AS slow FROM ({STREAMED})""")
def stream_metrics(spark, sf):
    """An ingest run seen by a listener: one row a batch, with its counts and its rate."""
    out, path = shared_path(spark, "ingest"), shared_path(spark, "metrics")
    with metrics.progress_table(spark, path) as table:
        run = ingest_run(spark, sf, out)
        run.awaitTermination()
        table.ended(run.runId)
    p = metrics.read_progress(spark, path)
    n = lambda k: F.sum(F.col("counters")[f"ingest.{k}"])
    return p.agg(F.count("*").alias("batches"), n("considered").alias("considered"), n("collected").alias("collected"),
                 F.count_if(~(F.col("rows_per_second") > 0)).alias("slow"))
