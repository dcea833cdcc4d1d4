"""Keyed state and progress rows, over restarts."""

from pyspark.sql import functions as F

from chronofold.streaming import ingest, metrics, refresh

SCHEMA = "id string, version long, text string"


def changes(spark, path, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{path}/{name}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{path}/*")


def test_newest_versions_over_restarts(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("changes", "table", "checkpoint"))
    run = lambda stream: refresh.start_newest(stream, table, checkpoint, "id", "version").awaitTermination()
    now = lambda: {(r.id, r.version, r.text) for r in refresh.read_newest(spark, checkpoint).collect()}
    run(changes(spark, source, [("a", 3, "a3"), ("a", 1, "a1"), ("b", 1, "b1"), ("c", None, "c?")], "1"))
    assert now() == {("a", 3, "a3"), ("b", 1, "b1"), ("c", None, "c?")}
    # Started again: a late older version and a repeated one are passed over.
    run(changes(spark, source, [("a", 2, "late"), ("b", 1, "again"), ("c", 1, "c1"), ("d", 7, "d7")], "2"))
    assert now() == {("a", 3, "a3"), ("b", 1, "b1"), ("c", 1, "c1"), ("d", 7, "d7")}
    written = spark.read.parquet(table)
    assert sorted(r.id for r in written.where("batch > 0").collect()) == ["c", "d"]  # a batch writes what is new in it


def dump(path, name, ids):
    text = "".join(f"<page><title>P {i}</title><ns>0</ns><text>{{{{Infobox person\n|birth_date = {1500 + i}\n}}}}</text></page>\n" for i in ids)
    path.mkdir(exist_ok=True)
    (path / name).write_text(text)


def test_one_progress_row_a_batch(spark, tmp_path):
    path = str(tmp_path / "metrics")

    def run():
        with metrics.progress_table(spark, path) as table:
            q = ingest.start_ingest(spark, str(tmp_path / "dump"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
            q.awaitTermination()
            table.ended(q.runId)

    dump(tmp_path / "dump", "a.xml", range(5))
    dump(tmp_path / "dump", "b.xml", range(5, 7))
    run()
    dump(tmp_path / "dump", "c.xml", range(7, 11))
    run()
    run()  # nothing new
    rows = metrics.read_progress(spark, path).orderBy("batch").collect()
    assert [r.batch for r in rows] == [0, 1, 2] and len({r.query_id for r in rows}) == 1 and len({r.run_id for r in rows}) == 2
    assert sorted(r.counters["ingest.considered"] for r in rows) == [2, 4, 5] and rows[2].counters["ingest.person"] == 4
    assert all(r.input_rows > 0 and r.batch_ms > 0 for r in rows)
    assert ingest.progress_totals(spark, str(tmp_path / "out")).first().considered == 11
    assert metrics.read_progress(spark, path).agg(F.sum("input_rows")).first()[0] >= 11
