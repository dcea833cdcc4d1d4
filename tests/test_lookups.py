"""Look-ups by id skip what cannot hold it."""

from pyspark.sql import functions as F

from chronofold.operators import filters as f
from chronofold.sources import sinks


def scanned(df):
    """(rows found, rows that the scan gave)."""
    n = len(df.collect())
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return n, leaf.metrics().apply("numOutputRows").value()


def entries(spark, n):
    none = F.array().cast("array<struct<type:string,lat:double,lng:double,centerLat:double,centerLng:double,radiusKm:double,rings:array<array<array<double>>>,"
                              "polygons:array<array<array<array<double>>>>,waypoints:array<struct<lat:double,lng:double,t:double,label:string>>,uncertain:boolean,label:string>>")
    zero = F.lit(0)
    return spark.range(n).select(F.sha1(F.col("id").cast("string")).alias("slug"), F.concat(F.lit("t"), F.md5(F.col("id").cast("string"))).alias("title"), none.alias("locations"),
                                 *[zero.alias(c) for c in ("start_year", "start_month", "start_day", "end_year", "end_month", "end_day", "uncertainty_years")],
                                 F.lit("event").alias("category"))


def test_absent_ids_read_no_row_group(spark, tmp_path):
    e = entries(spark, 20_000).repartition(4, "slug")
    sinks.load_tables(e, str(tmp_path))
    stored = spark.read.parquet(str(tmp_path / "entries"))
    there = stored.orderBy("id").offset(10_000).select("id", "slug", "title").first()
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id string")
    # Ids are random, so least and largest of a row group rule nothing out.
    absent = there.id[:-4] + ("0000" if there.id[-4:] != "0000" else "1111")
    assert scanned(f.by_ids(stored, ids(absent, None))) == (0, 0)
    found, read = scanned(f.by_ids(stored, ids(there.id)))
    assert found == 1 and 0 < read < 20_000
    assert scanned(stored.where(F.col("title") == there.title + "x")) == (0, 0)
    assert scanned(stored.where(F.col("slug") == there.slug[:-1] + "!")) == (0, 0)


def test_many_ids_are_joined(spark, monkeypatch):
    df, ids = spark.range(50), spark.createDataFrame([(3,), (7,), (7,), (None,), (99,)], "id long")
    want = [3, 7]
    assert sorted(r.id for r in f.by_ids(df, ids).collect()) == want
    monkeypatch.setattr(f, "AS_VALUES", 1)
    assert sorted(r.id for r in f.by_ids(df, ids).collect()) == want
