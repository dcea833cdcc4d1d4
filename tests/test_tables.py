"""Stored tables, guards, plans and streams."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chronofold.operators import facts, filters, lanes, searches
from chronofold.plans import fixtures
from chronofold.schema import LOCATIONS
from chronofold.sources import files, sinks
from chronofold.streaming import ingest, refresh

SF = "/root/testdata/sf0.001"
ENTRY = ("slug string, title string, start_year int, start_month int, start_day int, end_year int, end_month int, end_day int,"
         "uncertainty_years double, category string, loc string")


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY).withColumn("locations", F.from_json("loc", LOCATIONS)).drop("loc")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_stored_files(spark, tmp_path):
    sinks.load_tables(entries(spark, ("a", "A", 1, 0, 0, 5, 0, 0, 0.0, "event", '[{"type":"point","lat":1,"lng":2}]'),
                              ("b", "B", 1, 0, 0, 5, 0, 0, 0.0, "place", "[]")), str(tmp_path))
    df = filters.overlapping_years(filters.in_categories(spark.read.parquet(f"{tmp_path}/entries"), ["event"]), 0, 3).select("slug")
    p = plan(df)
    assert "PartitionFilters: [isnotnull(category" in p and "LessThanOrEqual(start_year,3)" in p and "title" not in p
    assert [r.slug for r in df.collect()] == ["a"]
    assert spark.read.parquet(f"{tmp_path}/locations").join(spark.read.parquet(f"{tmp_path}/entries"), F.col("entry_id") == F.col("id")).count() == 1


@pytest.mark.parametrize("row", [
    ("a", "A", 1, 0, 0, 5, 0, 0, 0.0, "event", '[{"type":"sphere"}]'),
    ("a", "A", 1, None, 0, 5, 0, 0, 0.0, "event", "[]"),
    ("a", "A", 1, 0, 0, 5, 0, 0, float("nan"), "event", "[]"),
    ("a", "A", 1, 0, 0, 5, 0, 0, 0.0, "event", '[{"type":"circle","centerLat":1,"centerLng":1}]')])
def test_bad_rows_stop_a_load(spark, tmp_path, row):
    with pytest.raises(PySparkException):
        sinks.load_tables(entries(spark, row), str(tmp_path))


def test_other_geometries_are_errors(spark):
    df = spark.createDataFrame([("LineString", "[[0,0],[1,1]]")], "k string, c string")
    with pytest.raises(PySparkException):
        df.select(files.as_multipolygon(F.col("k"), F.col("c"))).collect()


def test_unknown_category_is_an_error(spark):
    with pytest.raises(ValueError):
        filters.in_categories(fixtures.entries(spark, SF), ["person", "nonsense"])
    with pytest.raises(ValueError):
        facts.rules_for(["other"])
    with pytest.raises(ValueError):
        filters.check_uuids(["not-an-id"])


def test_missing_catalog_gives_the_defaults(spark, tmp_path):
    assert "person" in files.types_from_file(spark, str(tmp_path / "none.tsv"))


def test_lanes_need_no_shuffle_of_points(spark):
    from chronofold.plans.places import polygons
    points = spark.read.parquet(f"{SF}/orders.parquet").select(
        F.col("o_orderkey").alias("entry_id"), (F.col("o_orderkey") % 360 - 180).cast("double").alias("lng"), (F.col("o_custkey") % 180 - 90).cast("double").alias("lat"))
    p = plan(lanes.assign_lanes(points, polygons(spark, SF), ["entry_id"]))
    outer = p[:p.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in outer and "hashpartitioning" not in outer


def test_search_lines(spark):
    rows = [(1, 1, "category", "person, nonsense", None, None), (1, 2, "category", "nonsense", None, None), (1, 3, "year", None, 500.0, -100.0),
            (1, 4, "year", None, 0.0, 900.0), (1, 5, "limit", None, 0.0, None), (1, 6, "text", "ROME", None, None), (1, 7, "lat", None, 5.0, -5.0),
            (2, 1, "limit", None, 9999.0, None), (3, 1, "inside", "a", None, None), (3, 2, "inside", "b", None, None)]
    df = spark.createDataFrame(rows, "query_id int, seq int, kind string, str_value string, lo double, hi double")
    b = {r.query_id: r for r in searches.resolve(df, (-200, 400), (0.0, 9.0, -20.0, 20.0)).collect()}
    assert (b[1].categories, b[1].year_min, b[1].year_max, b[1].row_limit, b[1].text) == (["person"], 0.0, 400.0, 1, "rome")
    assert (b[1].lat_min, b[1].lat_max, b[1].lng_min) == (0.0, 5.0, -20.0)
    assert (b[2].row_limit, b[2].year_min, b[2].categories, b[3].inside) == (9999, -200.0, None, "b")
    cut = {r.query_id: r.row_limit for r in searches.resolve(df, most=500).collect()}
    assert (cut[1], cut[2]) == (1, 500)


def dump_part(path, name, ids):
    text = "".join(f"<page><title>P {i}</title><ns>0</ns><text>{{{{Infobox person\n|birth_date = {1500 + i}\n}}}}</text></page>\n" for i in ids)
    (path / name).write_text(text)


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    parts, out, state = tmp_path / "dump", str(tmp_path / "out"), str(tmp_path / "state")
    parts.mkdir()
    dump_part(parts, "1.xml", range(5))
    run = lambda: ingest.start_ingest(spark, str(parts), out, state).awaitTermination()
    run()
    dump_part(parts, "2.xml", range(5, 8))
    run()
    run()
    got = spark.read.parquet(f"{out}/entries")
    assert sorted(r.id for r in got.collect()) == [f"p-{i}" for i in range(8)]
    total = ingest.progress_totals(spark, out).first()
    assert (total.parts, total.considered, total.collected, total.person) == (2, 8, 8, 8)


def test_refresh_and_compaction(spark, tmp_path):
    src, table, small = (str(tmp_path / n) for n in ("src", "table", "small"))
    shape = "id int, v string, last_updated int"
    for rows in ([(1, "a", 1), (2, "a", 5)], [(1, "b", 3), (2, "old", 2), (3, "c", 1)]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(src)
        changes = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(src)
        refresh.start_refresh(changes, table, str(tmp_path / "state")).awaitTermination()
    want = {(1, "b", 3), (2, "a", 5), (3, "c", 1)}
    assert {tuple(r) for r in refresh.read_latest(spark, table).collect()} == want
    refresh.compact(spark, table, small)
    assert {tuple(r) for r in refresh.read_latest(spark, small).collect()} == want


def test_settings_file(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("# note\nexclude_category\tother\nexclude_category\tplace\ndate_before\t2000\nexclude_no_coords\t1\n"
                                    "max_birth_year\tperson\t1899\nstream_stride\t100\nnonsense\n")
    rules, other = files.read_rules(spark, str(tmp_path / "c.tsv"))
    assert (rules.exclude_categories, rules.date_before, rules.require_points, rules.max_start_year) == (["other", "place"], 2000, True, {"person": 1899})
    assert other == {"stream_stride": "100"} and "person" in rules.include
