"""Work that grew faster than the input, or with one task, stays in bounds."""

import random

from pyspark.sql import functions as F

from chronofold import runtime
from chronofold.functions import text as X
from chronofold.functions.coords import wkt_point
from chronofold.operators import eras as R, facts as K, searches as Q, text_index as T
from chronofold.plans import files as P, refresh
from chronofold.sources import dump, files

SPEC = "query_id long, seq int, kind string, str_value string, lo double, hi double"
ENTRY = "id long, slug string, title string, description string, start_year int, end_year int, category string, tags array<string>"


def nodes(plan):
    """The nodes of a plan that has run, adaptive stages opened."""
    kind = plan.getClass().getSimpleName()
    inner = "plan" if kind.endswith("QueryStageExec") else {"AdaptiveSparkPlanExec": "executedPlan", "ReusedExchangeExec": "child"}.get(kind)
    kids = [getattr(plan, inner)()] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan, *[n for k in kids for n in nodes(k)]]


def rows_made(df):
    """(rows, the most rows that a join of its plan gave)."""
    rows = df.collect()
    joins = [n for n in nodes(df._jdf.queryExecution().executedPlan()) if "Join" in n.getClass().getSimpleName()]
    return rows, max(n.metrics().apply("numOutputRows").value() for n in joins)


def test_searches_by_index_meet_the_entries_that_hold_their_text(spark):
    """each of many searches met every entry of its years before its text was asked for."""
    rnd = random.Random(3)
    year = [rnd.randrange(-3000, 2000) for _ in range(1500)]
    rows = [(i, f"s{i:05}", f"Title {i % 500:04}", "words", y, y + rnd.randrange(400) if i % 7 else None, "event" if i % 3 else "place", []) for i, y in enumerate(year)]
    e = spark.createDataFrame(rows, ENTRY)
    lines = []
    for k in range(200):
        lines += [(k, 1, "text", f"{k:03}" if k % 5 else "title 0", None, None), (k, 2, "year", None, -3000.0 + k, 1900.0 - k), (k, 3, "limit", None, 1.0 + k % 60, None)]
        lines += [(k, 4, "category", "place", None, None)] if k % 4 == 0 else [(k, 4, "lat", None, 10.0, 60.0)] if k % 9 == 1 else []
    bounds = Q.resolve(spark.createDataFrame([*lines, (900, 1, "year", None, 0.0, 50.0)], SPEC))
    places = spark.createDataFrame([(i, float(i % 90), 0.0) for i in range(0, 1500, 2)], "entry_id long, lat double, lng double")
    index = T.build(e.select("id", Q.words_of(F.col("title"), F.col("description")).alias("words")))
    got, most = rows_made(Q.run_all(bounds, e, places, index=index))
    assert sorted(map(tuple, got)) == sorted(map(tuple, Q.run_all(bounds, e, places).collect())) and len(got) > 500
    assert most < 30_000  # of 300,000 pairs


def test_the_rarest_gram_leads(spark):
    """a gram that nearly all texts hold gave a row for each text and each search with it."""
    index = T.build(spark.createDataFrame([(i, f"number {i:09}") for i in range(2000)], "id long, words string"))
    asked = [f"{i:06}" for i in range(1000, 1200)]
    found, most = rows_made(T.matching(index, spark.createDataFrame([(t,) for t in asked], "text string")))
    assert sorted((r.text, r.id) for r in found) == sorted((t, i) for t in asked for i in range(2000) if t in f"number {i:09}")
    assert most <= 4000


def test_postings_are_kept_by_block(spark):
    """a posting was a row for each gram of each text, made three times and sorted."""
    index = T.build(spark.createDataFrame([(i, f"number {i:09}") for i in range(6000)], "id long, words string"))
    assert index.postings.count() < 15_000 and index.postings.agg(F.sum("n")).first()[0] > 70_000
    assert index.counts.where("gram = 'num'").agg(F.sum("n")).first()[0] == 6000


def test_many_searches_for_one_text_make_no_pairs(spark, monkeypatch):
    """searches for a common text met all entries of a bucket that hold it before their limits were looked at."""
    rnd = random.Random(8)
    year = [rnd.randrange(240) for _ in range(1200)]
    rows = [(i, f"s{i * 7 % 1200:05}" if i % 50 else None, f"Title {i}", "words", y, y + rnd.randrange(90), ["event", "place", None][i % 3], []) for i, y in enumerate(year)]
    e = spark.createDataFrame(rows, ENTRY)
    lines = []
    for k in range(300):
        lines += [(k, 1, "text", "title", None, None), (k, 2, "year", None, float(k % 200), 500.0 - k), (k, 3, "limit", None, 1.0 + k % 5, None)]
        lines += [(k, 4, "category", "place, person" if k % 8 else "event", None, None)] if k % 4 == 0 else []
    bounds = Q.resolve(spark.createDataFrame(lines, SPEC))
    index = T.build(e.select("id", Q.words_of(F.col("title"), F.col("description")).alias("words")))
    got, most = rows_made(Q.run_all(bounds, e, index=index))
    key = lambda r: (r[0], r[1], r[4])
    assert sorted(map(key, got)) == sorted(map(key, Q.run_all(bounds, e).collect())) and len(got) > 500
    assert sorted(r for r in map(tuple, got) if r[3]) == sorted(r for r in map(tuple, Q.run_all(bounds, e).collect()) if r[3])
    assert most < 10_000  # of 100,000 pairs
    monkeypatch.setattr(Q, "A_TASK", 100)  # entries of a bucket in several shares
    assert sorted(map(key, Q.run_all(bounds, e, index=index).collect())) == sorted(map(key, got))


def test_a_dump_is_written_by_all_cores(spark, tmp_path):
    """three bz2 files were written, and read a batch each, by three tasks."""
    spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("words "), "id").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    path, each = refresh.write_dump(spark, str(tmp_path))
    names = spark.read.format("binaryFile").load(path).select("path").collect()
    assert each >= spark.sparkContext.defaultParallelism and len(names) == 3 * each
    out = refresh.shared_path(spark, "ingest")
    refresh.ingest_run(spark, str(tmp_path), out).awaitTermination()
    assert spark.read.parquet(f"{out}/progress").agg(F.count("*"), F.sum("considered")).first() == (3, sum(i % 10 != 9 and i % 6 in (0, 1, 2, 4) for i in range(500)))


PAGES = ["<page><title>A</title><ns>0</ns><text a=\"1\">x &lt;b&gt; é漢𝔸 </text>", "<page><title>B</title><text>one</text><text>two</text>", "<page><title>C</title><text a",
         "<page><title>D</title></text><text>late</text> tail", "<page><title>E</title><text>open", "head <page> <page><title>F</title><textual>y</textual></text>",
         "<page><text>no title</text>", "<page><title>G</title><ns>4</ns><text>talk</text>", "<page><title>H</title><text/><text></text>", "no page", "",
         "<page><title>I</title><text>\n== h ==\n\n</text >", "<page><title>J<i></title><title>K</title><text>z</text>", "<page><title>L</title><text >></text>"]


def test_pages_by_positions(spark):
    """the ends of page text are found as the patterns find them, without trying a pattern at every character."""
    raw = spark.createDataFrame([(p,) for p in PAGES], "value string")
    page = F.regexp_extract("value", r"<page>([\s\S]*)\z", 1)
    text = r"<text[^>]*>([\s\S]*?)</text>"
    want = raw.filter(F.regexp_like(page, F.lit(text)) & F.regexp_like(page, F.lit("<title>[^<]*</title>")) & (F.regexp_extract(page, r"<ns>(\d+)</ns>", 1) != "4")).select(
        dump.decode_entities(F.regexp_extract(page, "<title>([^<]*)</title>", 1)).alias("title"), dump.decode_entities(F.regexp_extract(page, text, 1)).alias("wikitext"))
    got = dump.parse_pages(raw)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 7
    assert r"[\s\S]" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_of_an_entry_file_is_split_once(spark):
    """the tests of a line were pushed below its split, which was made again for each."""
    line = lambda *c: ("\t".join(c),)
    tail = ["5", "0", "0", "7", "0", "0", "a", "b", "", "x", "event", "", "d"]
    lines = [line("s1", "t", "[]", *tail, '["g"]'), line("s2", "t", "[{", *tail), line("s3", "t", '{"a":1}', *tail), line("s4", "t", "[]", "none", *tail[1:]), line("short", "t"), line("s5", "t", " []", *tail)]
    df = files.parse_entries(spark.createDataFrame(lines, "value string"))
    assert sorted((r.slug, r.start_year, r.end_year, r.tags) for r in df.collect()) == [("s1", 5, 7, ["g"]), ("s5", 5, 7, [])]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_points_of_literals(spark):
    """A literal is matched by one pattern."""
    rows = [("POINT(1.5 2.5)", 2.5, 1.5), (" point( -1.  .5 ) ", 0.5, -1.0), ("POINT(1.2.3 4..5)", 4.0, 1.2), ("POINT(1)", None, None), ("POINT(. 1)", None, None), ("", None, None), (None, None, None),
            ("xPOINT(1 2)", None, None), ("POINT(1 2) x", None, None), ("POINT(- 2)", None, None), ("LINESTRING(1 2, 3 4)", None, None)]
    got = spark.createDataFrame([(r[0],) for r in rows], "t string").select(wkt_point(F.col("t")).alias("p"))
    assert [(r.p.lat, r.p.lng) if r.p else (None, None) for r in got.collect()] == [r[1:] for r in rows]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 2


def test_long_documents_are_sorted_by_many_tasks(spark, monkeypatch):
    """the task that wrote a document sorted it, so its memory grew with the document."""
    rows = spark.range(3000).select((F.col("id") % 2).alias("doc"), (-F.col("id")).alias("seq"), F.format_string('{"k":%d,\n"t":"a\r"}', F.col("id")).alias("value")).repartition(5)

    def documents():
        path = P.long_documents(spark, rows, "[", "]", "test")
        found = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("t")).collect()
        return path, sorted(d + "]\n" for f in found for d in f.t.split("]\n") if d)

    one, want = documents()
    monkeypatch.setattr(P, "SORTED_BY_ONE", 100)
    shuffles = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many parts for so few rows
    try:
        many, got = documents()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", shuffles)
    assert got == want and len(got) == 2
    assert spark.read.text(many).select(F.col("_metadata.file_path")).distinct().count() == 2
    parts = spark.read.parquet(many.removesuffix("/*").rsplit("/", 1)[0] + "/test-parts-*")
    assert parts.select(F.col("_metadata.file_path")).distinct().count() > 4


def test_a_closure_does_not_pass_through_the_driver(spark, monkeypatch):
    """many edges are few bytes in a file, so Spark broadcast them, and the closure, in every round."""
    monkeypatch.setattr(K, "EDGE_ROWS", 100)
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 50)
    monkeypatch.setattr(runtime.small_enough, "__defaults__", (50,))
    monkeypatch.setattr(runtime.broadcast_or_merge, "__defaults__", (50,))
    edges = spark.range(2, 600).select(F.format_string("Q%d", F.col("id")).alias("child"), F.format_string("Q%d", F.floor(F.col("id") / 2)).alias("parent"))
    closure = K.descendants(edges, spark.createDataFrame([("Q1",), ("Q3",)], "root string"))
    under = {i for i in range(1, 600) if bin(i)[2:].startswith("11")}
    assert sorted(map(tuple, closure.collect())) == sorted([("Q1", f"Q{i}") for i in range(1, 600)] + [("Q3", f"Q{i}") for i in under])
    types = spark.range(4000).select(F.col("id").alias("item"), F.format_string("Q%d", F.col("id") % 700).alias("type_id"))
    met = K.category_items(types, [K.CategoryRule("person", "Q7", "P1"), K.CategoryRule("event", "Q3", "P2", transitive=True)], closure.filter("root = 'Q3'"))
    got = met.collect()
    assert sorted(map(tuple, got)) == sorted([(i, "person") for i in range(4000) if i % 700 == 7] + [(i, "event") for i in range(4000) if i % 700 in under])
    last = [n for n in nodes(met._jdf.queryExecution().executedPlan()) if "Join" in n.getClass().getSimpleName()]
    assert "SortMergeJoinExec" in [n.getClass().getSimpleName() for n in last]


TEXTS = ["", "plain words. and no number", "a &NBSP; b&nbsp;c", "<ref name=x/>one <REF>two\n</ref> three <b>four</b> <", "[[File:a b.jpg|thumb]] x [[ image : c]] y", "'''[[Category:z]]''' ['''[Category:q]] end of the line that is long enough.",
         "[http://a.b words here] and [https://c.d] and [[target|shown]] and [[bare]] make a line of more than forty letters. Next.", "tabs\t\tand  two blanks in a line that has surely more than forty characters! More",
         "== head ==\n* a list item that is longer than forty characters, so it would count as prose.\n   , ;(The prose line follows, it is longer than forty characters? Yes.\n", "{{a|{{b}}}} The text that follows a template and is long enough to be taken. {{c}}",
         "It ran from 300 BC until 200 BC. Later.", "No span here 12. From about 1500 to 1600 it stood.", "From 5 to 7 it slept. Then 10-20 AD came.", "Known 3,000–500 BCE; from one to 7.", "One 1 only. Two 2 3 BC - AD", None]


def test_patterns_are_tried_where_they_can_match(spark):
    """every pattern went through every text and every sentence, the span of a sentence eight times."""
    def plain(c, by):
        c = X.sub(X.sub(c, r"(?i)<ref(?![0-9A-Za-z_])[^>]*/>", by), r"(?i)<ref(?![0-9A-Za-z_])[^>]*>[\s\S]*?</ref>", by)
        return c if by else X.sub(c, "<[^>]+>")

    def described(c):
        c = X._drop_templates(plain(c, ""), "")
        for p, by in ((rf"(?i)\[\[{X.WS}*(?:File|Image){X.WS}*:[^\]]*\]\]", ""), (rf"\[https?://[^{X.SPACES}\]]+{X.WS}+([^\]]+)\]", "$1"), (r"\[https?://[^\]]*\]", ""), (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"),
                      ("'{2,3}", ""), ("==+[^=]+=+", ""), (r"(?i)\[\[Category:[^\]]*\]\]", ""), ("[ \\t]{2,}", " ")):
            c = X.sub(c, p, by)
        lines = F.transform(F.split(c, "\n"), lambda x: X.sub(X.sub(x, rf"^[{X.SPACES},;()\[\]]+"), rf"{X.WS}+\z"))
        first = F.get(F.filter(lines, lambda x: (F.length(x) > 40) & ~F.substring(x, 1, 1).isin("*", "|", "{")), F.lit(0))
        return F.coalesce(X.trim_all(F.coalesce(X.group(first, r"^([^.!?]+[.!?])", 1), first)), F.lit(""))

    t = F.col("t")
    prose = X.sub(X._drop_templates(plain(X.sub(t, "(?i)&nbsp;", " "), " "), " "), rf"(?i)\[\[{X.WS}*(?:File|Image){X.WS}*:[^\]]*\]\]", " ")
    df = spark.createDataFrame([(x,) for x in TEXTS], "t string")
    for r in df.select("t", X.strip_citations(t).alias("s"), prose.alias("s0"), X.description(t).alias("d"), described(t).alias("d0")).collect():
        assert (r.s, r.d) == (r.s0, r.d0), r.t
    spans = df.select("t", R.explicit_range(t).alias("r"))
    got = {r.t: (r.r.start_year, r.r.end_year, r.r.start_expr, r.r.end_expr) for r in spans.collect() if r.r}
    assert got == {TEXTS[10]: (-300, -200, "300 BC", "200 BC"), TEXTS[11]: (1500, 1600, "1500", "1600"), TEXTS[12]: (10, 20, "10", "20 AD"), TEXTS[13]: (-3000, -500, "3,000", "500 BCE")}
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert "[0-9][^0-9]+[0-9]" in plan
