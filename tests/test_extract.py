"""Page extraction on small hand-made pages."""

import bz2

import pytest
from pyspark.sql import functions as F

from chronofold.functions import coords, dates
from chronofold.functions.text import description, with_suffixes
from chronofold.operators import catalog, eras, extract
from chronofold.sources import dump


def dates_of(spark, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    d = df.select("i", dates.parse_date(F.col("v")).alias("d")).orderBy("i").collect()
    return [None if r.d is None else (r.d.start_year, r.d.start_month, r.d.start_day, r.d.end_year, r.d.uncertainty_years) for r in d]


def test_dates(spark):
    assert dates_of(
        spark, "{{birth date|1564|4|23}}", "{{Death date and age|1616|4|23|1564|4|23}}", "12 March 44 BC", "July 4, 1776",
        "1337–1453", "c. 2560 BC", "3rd century BC", "5th century", "10000 BC", "1900-01-02", "12 Brumaire 1799", "  ", "unknown",
        "[[1066]] {{circa}} 1067", "1 Jan 1900") == [
        (1564, 4, 23, 1564, 20), (1616, 4, 23, 1616, 20), (-44, 3, 12, -44, 20), (1776, 7, 4, 1776, 20),
        (1337, 0, 0, 1453, 50), (-2560, 0, 0, -2560, 100), (-300, 0, 0, -200, 50), (400, 0, 0, 500, 50),
        # A year has at most four digits, and a day in figures reads as a range.
        (1000, 0, 0, 1000, 20), (1, 0, 0, 1900, 10), (1799, 0, 12, 1799, 20), None, None,
        (1067, 0, 0, 1067, 100), (1900, 1, 1, 1900, 20)]


def test_calendar(spark):
    df = spark.createDataFrame([("622 AH",), ("1 May 1700 OS",), ("5760 AM",), ("Utah",), ("1700",), ("ahé",)], "v string")
    assert [r[0] for r in df.select(dates.calendar(F.col("v"))).collect()] == ["islamic", "julian", "hebrew", "islamic", "gregorian", "islamic"]


@pytest.mark.parametrize("text,points", [
    ("{{coord|51|30|N|0|7|30|W|display=title}}", [(51.5, -0.125)]),
    ("{{Coord|-33.5|151.25|type:city}}", [(-33.5, 151.25)]),
    ("{{coord|95|10}} {{coord|1|2}} {{coord|1.00005|50}}", [(1.0, 2.0)]),
    ("{{coord|12e|3}} {{coord|5|6|7", []),
    ("{{#invoke:Coordinates|coord|10|S|20|E}}", [(-10.0, 20.0)]),
    ("{{coord|{{coord|3|4}}", [(3.0, 4.0)]),
    ("|lat_deg=10|lat_min=30|lon_deg=20|lonEW=W", [(10.5, -20.0)]),
    ("| Latitude = 7.5\n|longitude= -8", [(7.5, -8.0)]),
    ("| latitude = 7.5", []),
])
def test_points(spark, text, points):
    df = spark.createDataFrame([(text,)], "t string").select(coords.page_points(F.col("t"), F.array().cast("array<string>")).alias("p"))
    assert [(p.lat, p.lng) for p in df.first().p] == points


def test_strict_points_keep_two_places_on_one_parallel(spark):
    df = spark.range(1).select(F.array(*[F.struct(F.lit(10.0).alias("lat"), F.lit(x).alias("lng")) for x in (1.0, 50.0, 1.00001)]).alias("p"))
    loose, strict = df.select(F.size(coords.distinct_points(F.col("p"))), F.size(coords.distinct_points(F.col("p"), True))).first()
    assert (loose, strict) == (1, 2)


def fields_of(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(extract.page_templates(F.col("t")).alias("x"))
    return {f.key: f.value for f in df.first().x.fields}


def test_fields(spark):
    assert fields_of(spark, "{{Infobox ship\n| Name = A {{x|y=1}}\n|a=\n| date = {{start|1}} tail\n|name=B\n{{Infobox ship career\n|launched = 1800<br>}}\n}} {{cite web|date=2020}}") == {
        "name": "A", "a": "", "date": "{{start|1}}", "launched": "1800<br>"}
    assert fields_of(spark, "{{Infobox person | birth_date = 1900 ") == {}
    assert fields_of(spark, "{{Infobox a|x=1}}{{infobox b|x=2|y=3}}") == {"x": "1", "y": "3"}


def page(box, tail="", kind="person"):
    return f"{{{{Infobox {kind}\n{box}\n}}}}\n{tail}"


def test_start_and_end(spark):
    rows = [
        ("A", page("|death_date = 1616\n|birth_date = {{birth date|1564|4|23}}")),
        ("B", page("|birth_date = 1700\n|death_date = 1650")),
        ("C", page("|birth_date = unknown\n|date = 5 May 1800\n|end_date2 = 1800")),
        ("D", page("|founded = 1200\n|established_date3 = 1100\n|dissolved = 1300", kind="settlement")),
        ("E", page("|founded = 1200", kind="person")),
        ("F", page("|birth_date = 1700", kind="album")),
    ]
    j = extract.judge_pages(spark.createDataFrame(rows, "title string, wikitext string"))
    got = {r.title: (r.s, r.e, r.reject_reason) for r in j.select(
        "title", F.col("dates.start.start_year").alias("s"), F.col("dates.end.start_year").alias("e"), "reject_reason").collect()}
    assert got == {"A": (1564, 1616, None), "B": (1700, None, None), "C": (1800, None, None),
                   "D": (1200, 1300, None), "E": (None, None, "no start date")}


def test_description(spark):
    text = ("{{Infobox person|a={{b|{{c}}}}}}\n<ref name=x /> short\n'''Ada''' was a [[mathematician|number person]] of the [http://x.y fine] age"
            "<ref>{{cite|title=no}} Not this.</ref> who wrote. More here.\n")
    df = spark.createDataFrame([(text,), ("short",)], "t string").select(description(F.col("t")))
    assert [r[0] for r in df.collect()] == ["Ada was a number person of the fine age who wrote.", ""]


def test_types_and_categories(spark):
    df = spark.createDataFrame([("{{Infobox  Military Conflict |x}} {{infobox person\n}} {{Infoboxes}}",)], "t string")
    assert df.select(catalog.infobox_types(F.col("t"))).first()[0] == ["military_conflict", "person"]
    want = {"military_conflict": "event", "royal_house": "pol_mil_organization", "royalty": "person", "train_station": "place",
            "war_faction": "pol_mil_organization", "film_award": "other", "film": "artifact", "technology": "concepts",
            "video_game": "artifact", "book_series": "other", "software_license": "other", "mine": "place", "mineral": "other",
            "aircraft_occurrence": "event", "company": "business", "dynasty": "historical_period", "martial_artist": "person",
            "martial_art": "concepts", "album": "artifact", "unknown_thing": "other", "cricketer": "person", "musical": "artifact"}
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", catalog.category_of(F.col("t")).alias("c"))
    assert {r.t: r.c for r in df.collect()} == want


def test_suffixes_skip_taken_slugs(spark):
    df = spark.range(1).select(with_suffixes(F.array(*[F.lit(x) for x in ["a", "a-x", "a", "b", "a"]])))
    assert df.first()[0] == ["a", "a-x", "a-x-x", "b", "a-x-x-x"]


def test_split_bz2_dump(spark, tmp_path):
    """Three bz2 streams one after another in one file."""
    one = lambda n, ns="<ns>0</ns>": f"<page>\n<title>T &amp;amp; {n}</title>{ns}<revision><text x='1'>a &amp;lt;b&gt; {n}</text></revision></page>\n"
    parts = ["<mediawiki>" + one(1) + one(2, "<ns>4</ns>"), one(3, "") + "<page><title>none</title></page>", one(4) + "</mediawiki>"]
    (tmp_path / "d.xml.bz2").write_bytes(b"".join(bz2.compress(p.encode()) for p in parts))
    got = sorted((r.title, r.wikitext) for r in dump.read_pages(spark, str(tmp_path)).collect())
    # The ampersand is decoded first and each entity once: &amp;lt; opens fully, &amp;amp; by one step.
    assert got == [(f"T &amp; {n}", f"a <b> {n}") for n in (1, 3, 4)]


def test_sections(spark):
    text = "lead\n== A ==\na\n==== Deep ====\nd\n=== B ===\nb\n== References ==\nr\n=== C ===\nc\n==D==\nx = y\n"
    df = spark.createDataFrame([(text,), ("no headings",)], "t string").select(eras.sections(F.col("t")).alias("s"))
    a, none = df.collect()
    assert [(s.title, s.level) for s in a.s] == [("A", 2), ("A – Deep", 4), ("A – B", 3), ("References – C", 3), ("D", 2)]
    assert a.s[0].body == "\na\n==== Deep ====\nd\n=== B ===\nb\n" and a.s[4].body == "\nx = y\n"
    assert none.s is None


def spans(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    df = df.withColumn("r", eras.explicit_range(F.col("t")))
    df = eras.with_mentions(df, "t").withColumn("m", eras.mention_span(F.col("mentions")))
    return [tuple(None if x is None else (x.start_year, x.end_year, x.start_expr, x.end_expr) for x in (r.r, r.m)) for r in df.orderBy("i").collect()]


def test_spans(spark):
    got = spans(
        spark, "From 1789 in France until about 1914.", "It ran from 12 to 15 things. Then 63 BCE – 14 CE.", "1766-1045 BCE",
        "7-5 million years ago and the 3rd century BC", "nothing", "from 500 to 300 BC", "in 1990 and 2045 and 1,200 AD", "40,000 years ago")
    assert got[0] == ((1789, 1914, "1789", "1914"), (1789, 1914, "1789", "1914"))
    assert got[1][0] == (-63, 14, "63 BCE", "14 CE")
    assert got[2] == ((-1766, -1045, "1766", "1045 BCE"),) * 2
    assert got[3] == (None, (-7000000, -300, "7 million years ago", "3rd century BC"))
    assert got[4] == (None, None)
    assert got[5][0] == (-500, -300, "500", "300 BC")
    assert got[6] == (None, (1200, 1990, "1,200 AD", "1990"))
    assert got[7] == (None, (-40000, -40000, "40,000 years ago", "40,000 years ago"))
