"""Nothing is cut that nobody asked to cut; chunks are loaded by category."""

from pyspark.sql import functions as F

from chronofold.operators import entries as E, filters as f, incremental as I, searches as Q

ENTRY = "id long, slug string, title string, description string, start_year int, end_year int, category string, tags array<string>"


def many(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("s"), F.lpad("id", 5, "0")).alias("slug"), F.lit("t").alias("title"), F.lit("d").alias("description"),
                                 F.col("id").cast("int").alias("start_year"), F.col("id").cast("int").alias("end_year"), F.lit("place").alias("category"),
                                 F.array().cast("array<string>").alias("tags"))


def test_pages_and_limits_of_any_size(spark):
    e = many(spark, 900)
    locations = e.select(F.col("id").alias("entry_id"), F.lit(0).alias("ordinal"), F.lit(1.0).alias("lng"))
    assert E.page_with_locations(f.first_entries(e, 700), locations, "lng").filter("size(locations) = 1").count() == 700
    assert f.first_entries(e, 900).count() == 900 and f.first_entries(e, 900, most=500).count() == 500


def test_saved_search_without_years_and_with_a_large_limit(spark):
    spec = spark.createDataFrame([(1, 1, "category", "place", None, None), (1, 2, "limit", None, 2000.0, None), (2, 1, "category", "place", None, None),
                                  (2, 2, "limit", None, 2000.0, None), (3, 1, "limit", None, 5.0, None)],
                                 "query_id long, seq int, kind string, str_value string, lo double, hi double")
    old = spark.createDataFrame([(5000, "old", "t", "d", -500_000_000, -499_000_000, "place", [])], ENTRY)
    found = Q.run_all(Q.resolve(spec), many(spark, 900).unionByName(old))
    assert {r.query_id: r.n for r in found.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {1: 901, 2: 901, 3: 5}
    assert {r.query_id for r in found.filter("slug = 'old' AND rank = 1").collect()} == {1, 2, 3}
    assert Q.resolve(spec, most=500).agg(F.max("row_limit")).first()[0] == 500


def test_chunks_of_two_categories(spark, tmp_path):
    records = spark.createDataFrame([(1, "person", 3), (2, "person", 9), (3, "event", 4), (4, "event", 40)], "id long, category string, year int")
    chunks = spark.createDataFrame([("person", 0, 9), ("event", 0, 9)], "category string, low int, high int")
    none = spark.createDataFrame([], "category string, low int, high int, n long, completed_at timestamp")
    path = str(tmp_path / "stored")
    count = lambda df: {(r.category, r.low): r.n for r in df.collect()}
    done = I.load_chunks(records, chunks, none, path)
    assert count(done) == {("person", 0): 2, ("event", 0): 1}
    assert spark.read.parquet(path).count() == 3
    more = chunks.unionByName(spark.createDataFrame([("event", 40, 49), ("place", 0, 9)], chunks.schema))
    again = I.load_chunks(records, more, done, path)
    assert count(again) == {("person", 0): 2, ("event", 0): 1, ("event", 40): 1, ("place", 0): 0}
    assert spark.read.parquet(path).count() == 4


def test_first_load_without_records(spark, tmp_path):
    records = spark.createDataFrame([], "id long, category string, year int")
    chunks = spark.createDataFrame([("person", 0, 9)], "category string, low int, high int")
    none = spark.createDataFrame([], "category string, low int, high int, n long, completed_at timestamp")
    assert [r.n for r in I.load_chunks(records, chunks, none, str(tmp_path / "stored")).collect()] == [0]


def test_templates_of_any_depth(spark):
    from chronofold.functions.text import description, strip_citations, template_depth
    deep = lambda n: "{{a|" * n + "x" + "}}" * n
    rows = [(0, "plain"), (50, f"one {deep(50)} two"), (2, "a {{b}} c {{d|{{e}}}} f"), (1, "lost }} {{x}} {{open"), (1, "{{{arg}}}"), (1, "{{ {single} }} stays")]
    df = spark.createDataFrame(rows, "depth int, t string")
    got = df.select("depth", template_depth(F.col("t")).alias("d"), strip_citations(F.col("t")).alias("s")).collect()
    assert [r.d for r in got] == [0, 50, 2, 1, 1, 1]
    assert got[1].s.split() == ["one", "two"] and got[2].s.split() == ["a", "c", "f"] and got[3].s.split() == ["lost", "}}", "{{open"]
    assert got[4].s == "{ }" and got[5].s == "{{ {single} }} stays"
    sentence = "A sentence of many words " + "and more words " * 40
    page = spark.createDataFrame([(f"{deep(30)}\n{sentence}end.",), (sentence,)], "t string")
    whole, line = [r[0] for r in page.select(description(F.col("t"))).collect()]
    assert whole == f"{sentence}end." and line == sentence.strip()
    assert [len(r[0]) for r in page.select(description(F.col("t"), 150, 200)).collect()] == [200, 150]


def test_a_span_stated_late(spark):
    from chronofold.operators.eras import explicit_range
    df = spark.createDataFrame([("Words without a year. " * 60 + "It lasted from 300 BC until 200 BC.",)], "t string")
    assert df.select(explicit_range(F.col("t")).alias("r")).first().r.start_year == -300
    assert df.select(explicit_range(F.col("t"), 400).alias("r")).first().r is None


def test_chunks_by_sketches(spark):
    from chronofold.operators import facts as K
    dates = spark.range(40_000).select((F.col("id") * 7919 % 9000).alias("item"), (F.col("id") * 31 % 2600 - 7_000_000 * (F.col("id") % 50 == 0).cast("int")).cast("int").alias("year"))
    low, high, most = -7_100_000, 2_100, 1_500
    plan = K.plan_chunks_sketched(dates, low, high, most).collect()
    spans = sorted((r.low, r.high) for r in plan)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    rows = dates.filter(F.col("year").between(low, high)).collect()
    exact = {s: len({r.item for r in rows if s[0] <= r.year <= s[1]}) for s in spans}
    assert sum(any(a <= r.year <= b for a, b in spans) for r in rows) == len(rows)
    assert all(abs(r.n - exact[r.low, r.high]) <= max(2, 0.07 * exact[r.low, r.high]) for r in plan)
    assert all(n <= 1.07 * most for s, n in exact.items() if s[0] < s[1])
    assert 1 < len(plan) < 100 and K.plan_chunks_sketched(dates.limit(0), low, high, most).collect() == []
    exactly = K.plan_chunks(dates.filter("year > -3000"), -3000, 2100, most).collect()
    assert abs(len(exactly) - len(K.plan_chunks_sketched(dates.filter("year > -3000"), -3000, 2100, most).collect())) <= 2


def test_chunks_of_any_width(spark):
    chunks = spark.createDataFrame([("a", -7_000_000, -3_001), ("a", -3_000, 0), ("a", 1, 1), ("a", 2, 3), ("a", 9, 1000), ("b", -10, 10), ("b", 30, 20)], "category string, low int, high int")
    years = [-7_000_001, -7_000_000, -4_194_305, -3_001, -3_000, -1, 0, 1, 2, 3, 4, 8, 9, 512, 1000, 1001, 25, None]
    records = spark.createDataFrame([(i, c, y) for i, y in enumerate(years) for c in "abc"], "id long, category string, year int")
    want = sorted((c, y, lo, hi) for y in years if y is not None for c, lo, hi in [tuple(r) for r in chunks.collect()] if lo <= y <= hi)
    got = I.records_of(records, chunks)
    assert sorted((r.category, r.year, r.low, r.high) for r in got.collect()) == want
    assert I.records_of(records, chunks.limit(0)).collect() == []
