"""Entries out of a table of facts.

claims: (item, prop, value_item, value_time, precision, value_point), one row
per statement, best stored partitioned by prop.  labels and descriptions:
(item, lang, text).  articles: (item, title).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronofold.functions.coords import wkt_point
from chronofold.functions.dates import fact_time
from chronofold.functions.text import group
from chronofold.operators.filters import in_box, label_contains
from chronofold.runtime import broadcast_if_small, broadcast_or_merge, cut, keep_if, small_enough

# Subclass edges that may be broadcast: two short columns.
EDGE_ROWS = 300_000


@dataclass(frozen=True)
class CategoryRule:
    category: str
    root: str                  # type an item must have
    date_prop: str
    transitive: bool = False   # also any subclass of root
    place: str = "none"        # "direct", "none", or the property that leads to the place


# How each category is found among the facts.
CATEGORY_RULES = [
    CategoryRule("person", "Q5", "P569", place="P19"),
    CategoryRule("event", "Q1656682", "P585", transitive=True, place="direct"),
    CategoryRule("place", "Q618123", "P571", place="direct"),
    CategoryRule("artifact", "Q838948", "P571", place="direct"),
    CategoryRule("pol_mil_organization", "Q43229", "P571", place="P159"),
    CategoryRule("business", "Q4830453", "P571", place="P159"),
    CategoryRule("historical_period", "Q11514315", "P580"),
    CategoryRule("concepts", "Q151885", "P571"),
]

# Direct types of events that are left out.
EVENT_NOISE = ["Q27020041", "Q18608583", "Q18536594", "Q15261477", "Q1057954", "Q24397514",
               "Q26466721", "Q15280243", "Q152450", "Q7864918", "Q24333627", "Q112711344"]


@dataclass(frozen=True)
class Exclusions:
    """What keeps an item out."""

    fictional_root: str = "Q14897293"
    fictional_prop: str = "P1074"
    sport_prop: str = "P641"
    occupation_prop: str = "P106"
    athlete_root: str = "Q2066131"
    event_noise: tuple[str, ...] = tuple(EVENT_NOISE)


def rules_for(categories: list[str] | None, rules: list[CategoryRule] = CATEGORY_RULES) -> list[CategoryRule]:
    """Rules of the asked-for categories; none asked means all."""
    got = [r for r in rules if not categories or r.category in categories]
    if not got:
        raise ValueError("no category can be looked up in the facts")
    return got


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, type): every type that reaches a root in zero or more steps.

    edges: (child, parent); roots: (root).  Breadth first from the roots, several
    hops per round; each round's new pairs are written out, so neither the plan
    nor the work to redo after a lost executor grows.  Cycles end by themselves:
    a known pair is never new.
    """
    edges = edges.select("child", "parent")
    few_edges = small_enough(edges, EDGE_ROWS)
    hops = 6 if few_edges else 2
    known = frontier = roots.select("root", F.col("root").alias("type")).distinct()
    while True:
        step = frontier.withColumnRenamed("type", "t0") if few_edges else broadcast_if_small(frontier.withColumnRenamed("type", "t0"))
        for n in range(hops):
            e = edges.select(F.col("parent").alias(f"t{n}"), F.col("child").alias(f"t{n + 1}"))
            step = step.join(F.broadcast(e) if few_edges else e.hint("merge"), f"t{n}", "left" if n else "inner")
        met = F.explode(F.array(*[F.col(f"t{n + 1}") for n in range(hops)])).alias("type")
        found = step.select("root", met).filter("type IS NOT NULL").distinct()
        frontier = cut(found.join(known if few_edges else known.hint("merge"), ["root", "type"], "left_anti"), "closure")
        if frontier.isEmpty():
            return known
        known = known.unionAll(frontier)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, member) over downward edges (parent, child), each once."""
    return descendants(edges, roots).withColumnRenamed("type", "member")


def of_type(types: DataFrame, root: str, closure: DataFrame | None = None) -> DataFrame:
    """(item): items with the type itself, or a type in its closure when one is given."""
    if closure is None:
        return types.filter(F.col("type_id") == root).select("item").distinct()
    wanted = closure.filter(F.col("root") == root).select(F.col("type").alias("type_id"))
    return types.join(broadcast_or_merge(wanted), "type_id", "left_semi").select("item").distinct()


def without(df: DataFrame, items: DataFrame) -> DataFrame:
    return df.join(items.select("item"), "item", "left_anti")


def without_types(df: DataFrame, types: DataFrame, excluded: list[str]) -> DataFrame:
    """Items with none of the excluded types as a direct type."""
    return without(df, types.filter(F.col("type_id").isin(*excluded)).select("item"))


def in_language(texts: DataFrame, lang: str = "en") -> DataFrame:
    """One text per item in the language."""
    return texts.filter(F.col("lang") == lang).groupBy("item").agg(F.min("text").alias("text"))


def category_items(types: DataFrame, rules: list[CategoryRule], closure: DataFrame) -> DataFrame:
    """(item, category): the union of all category branches in one pass over the
    types; an item may be in two."""
    spark = types.sparkSession
    exact = [(r.root, r.category) for r in rules if not r.transitive]
    deep = [(r.root, r.category) for r in rules if r.transitive]
    shape = "type_id string, category string"
    lookup = spark.createDataFrame(exact, shape)
    if deep:
        under = closure.join(F.broadcast(spark.createDataFrame(deep, "root string, category string")), "root")
        lookup = lookup.unionByName(under.select(F.col("type").alias("type_id"), "category"))
    return types.join(broadcast_or_merge(lookup), "type_id").select("item", "category").distinct()


def place_points(items: DataFrame, claims: DataFrame, rules: list[CategoryRule]) -> DataFrame:
    """(item, category, point): the places of the items (item, category), on the item itself or on the item a
    property leads to.  Points are read for these items alone, and each is parsed once."""
    spark = claims.sparkSession
    looks = spark.createDataFrame([(r.category, r.place) for r in rules if r.place != "none"], "category string, place string")
    at = cut(items.select("item", "category").distinct().join(F.broadcast(looks), "category"), "places")
    via = sorted({r.place for r in rules} - {"direct", "none"})
    where = at.filter("place = 'direct'").select("item", "category", F.col("item").alias("holder"))
    if via:
        links = claims.filter(F.col("prop").isin(*via)).select("item", F.col("prop").alias("place"), F.col("value_item").alias("holder"))
        where = where.unionByName(links.join(broadcast_if_small(at), ["item", "place"]).select("item", "category", "holder"))
    where = cut(where, "holders")
    held = of_items(claims.filter("prop = 'P625'"), where.select(F.col("holder").alias("item")))
    points = cut(held.select(F.col("item").alias("holder"), wkt_point(F.col("value_point")).alias("point")), "points")
    return where.join(points, "holder").select("item", "category", "point")


def with_places(items: DataFrame, claims: DataFrame, rules: list[CategoryRule]) -> DataFrame:
    """Add point (struct(lat, lng) or null): one row per place, one without when there is none."""
    return items.join(place_points(items, claims, rules), ["item", "category"], "left").select(*items.columns, "point")


def item_id(iri: Column) -> Column:
    return group(iri, r"/(Q\d+)\z", 1)


def as_entries(rows: DataFrame, rules: list[CategoryRule] = CATEGORY_RULES) -> DataFrame:
    """Fact rows (item, label, description, category, value_time, precision, point,
    article) in the shape of entries; t, if there, is the time as read."""
    types = F.create_map(*[x for r in rules for x in (F.lit(r.category), F.lit(r.root))])
    df = rows if "t" in rows.columns else rows.withColumn("t", fact_time(F.col("value_time"), F.col("precision")))
    year, month, day = (F.col(f"t.{p}") for p in ("year", "month", "day"))
    return df.select(
        F.col("item").alias("id"), F.coalesce("label", "item").alias("title"), "category", "point",
        F.col("value_time").alias("start_expr"), year.alias("start_year"), month.alias("start_month"), day.alias("start_day"),
        year.alias("end_year"), month.alias("end_month"), day.alias("end_day"),
        F.lit("gregorian").alias("calendar"), F.col("t.uncertainty_years").alias("uncertainty_years"),
        F.concat(F.lit("wikidata:"), F.coalesce(F.element_at(types, F.col("category")), F.lit(""))).alias("infobox_type"),
        F.coalesce("description", F.lit("")).alias("description"), F.array(F.lit("wikidata")).alias("tags"),
        F.col("article").alias("wikipedia_title"),
        F.concat(F.lit("https://www.wikidata.org/wiki/"), "item").alias("citation_url"), F.lit("Wikidata").alias("citation_label"))


def merge_by_id(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per id: the first row's values, and all different points in order of
    first appearance.  Equal points are dropped before anything is gathered."""
    seq = F.struct(*order)
    scalars = [c for c in rows.columns if c not in ("id", "point")]
    first = F.struct(*scalars)
    per_point = rows.groupBy("id", "point").agg(F.min(seq).alias("seq"), F.min_by(first, seq).alias("first"))
    points = F.sort_array(F.collect_list(F.when(F.col("point").isNotNull(), F.struct("seq", "point"))))
    out = per_point.groupBy("id").agg(F.min_by("first", "seq").alias("first"), points.alias("p"))
    return out.select("id", "first.*", F.col("p.point").alias("locations"))


SPORTS, FICTIONAL, NOISE = "sports", "fictional", "noise"


def item_marks(claims: DataFrame, rules: list[CategoryRule], closure: DataFrame, out: Exclusions) -> DataFrame:
    """(item, one true/false column per category and exclusion).

    Categories and exclusions are read off the same statements in one pass: each
    statement is turned into marks by a small table, and a partial maximum per item
    brings them together, however many statements an item has.
    """
    spark = claims.sparkSession
    exact = [("P31", r.root, r.category) for r in rules if not r.transitive] + [("P31", t, NOISE) for t in out.event_noise]
    under = [("P31", r.root, r.category) for r in rules if r.transitive]
    under += [("P31", out.fictional_root, FICTIONAL), (out.occupation_prop, out.athlete_root, SPORTS)]
    shape = "prop string, value_item string, mark string"
    roots = spark.createDataFrame(under, shape.replace("value_item", "root"))
    lookup = spark.createDataFrame(exact, shape).unionByName(
        closure.join(F.broadcast(roots), "root").select("prop", F.col("type").alias("value_item"), "mark"))
    always = F.when(F.col("prop") == out.sport_prop, SPORTS).when(F.col("prop") == out.fictional_prop, FICTIONAL)
    m = claims.filter(F.col("prop").isin("P31", out.occupation_prop, out.sport_prop, out.fictional_prop))
    m = m.join(broadcast_or_merge(lookup), ["prop", "value_item"], "left").select("item", F.coalesce(always, "mark").alias("mark"))
    marks = [r.category for r in rules] + [SPORTS, FICTIONAL, NOISE]
    return m.filter("mark IS NOT NULL").groupBy("item").agg(*[F.max(F.col("mark") == k).alias(f"is_{k}") for k in marks])


def of_items(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted items; the ids are sent to the scan when they are few."""
    ids = wanted.select("item").distinct()
    # Counted before they are made distinct, which takes a shuffle that the join can use but a count cannot pass on.
    return df.join(F.broadcast(ids) if small_enough(wanted) else ids, "item", "left_semi")


def search(claims: DataFrame, edges: DataFrame, labels: DataFrame, descriptions: DataFrame, articles: DataFrame,
           year_min: int, year_max: int, categories: list[str] | None = None, text: str | None = None,
           box: dict[str, float] | None = None, limit: int | None = None,
           rules: list[CategoryRule] = CATEGORY_RULES, out: Exclusions = Exclusions()) -> DataFrame:
    """Entries of the categories with a date in the years; an item may match in two.

    The closure of all roots is worked out once.  Dates come first; statements, labels and
    descriptions are read for the items that have one.  Every join is on the item alone.
    """
    spark = claims.sparkSession
    rules = rules_for(categories, rules)
    roots = sorted({r.root for r in rules if r.transitive} | {out.fictional_root, out.athlete_root})
    closure = descendants(edges, spark.createDataFrame([(r,) for r in roots], "root string"))
    props = spark.createDataFrame([(r.date_prop, r.category) for r in rules], "prop string, category string")
    dates = (claims.filter(F.col("prop").isin(*sorted({r.date_prop for r in rules})))
             .select("item", "prop", "value_time", fact_time(F.col("value_time"), F.col("precision")).alias("t")))
    dates = keep_if(dates, F.col("t.year").between(year_min, year_max)).join(F.broadcast(props), "prop").drop("prop")
    # The dates cut the items down most: what else is read is read for those alone.
    dated = cut(dates, "dated")
    kinds = claims.filter(F.col("prop").isin("P31", out.occupation_prop, out.sport_prop, out.fictional_prop))
    marks = item_marks(of_items(kinds, dated), rules, closure, out)
    fits = F.lit(False)
    for r in rules:
        keep = F.col(f"is_{r.category}")
        if r.category == "person":
            keep = keep & ~F.col(f"is_{SPORTS}")
        if r.category == "event":
            keep = keep & ~F.col(f"is_{NOISE}")
        fits = fits | ((F.col("category") == r.category) & keep)
    rows = dated.join(marks, "item").filter(fits & ~F.col(f"is_{FICTIONAL}")).select(*dated.columns)
    rows = cut(rows.join(articles.withColumnRenamed("title", "article"), "item"), "kept")
    rows = (rows.join(in_language(of_items(labels, rows)).withColumnRenamed("text", "label"), "item", "left")
            .join(in_language(of_items(descriptions, rows)).withColumnRenamed("text", "description"), "item", "left"))
    if text:
        rows = label_contains(rows, text)
    rows = with_places(cut(rows, "texts"), claims, rules)
    if box:
        rows = rows.filter(in_box(F.col("point.lat"), F.col("point.lng"), **box))
    merged = merge_by_id(as_entries(rows, rules), ["start_year", "category", "start_expr", "point"])
    return merged if limit is None else merged.orderBy("start_year", "id").limit(limit)


def count_in_years(dates: DataFrame, year_min: int, year_max: int) -> DataFrame:
    """Different items with a date in the range."""
    return dates.filter(F.col("year").between(year_min, year_max)).agg(F.countDistinct("item").alias("n"))


def plan_chunks(dates: DataFrame, year_min: int, year_max: int, most: int) -> DataFrame:
    """(low, high, n): the range halved until no part holds more than `most`
    different items; empty parts are dropped.

    An item counts in a range once, at its first year inside it: the year whose
    previous year lies before the range.  So (year, previous year) totals are
    enough, and the halving runs over that small table in one plan.
    """
    pairs = dates.filter(F.col("year").between(year_min, year_max)).select("item", "year").distinct()
    before = F.lag("year").over(W.partitionBy("item").orderBy("year"))
    totals = pairs.withColumn("before", before).groupBy("year", "before").agg(F.count(F.lit(1)).alias("c"))
    df = totals.withColumns({"low": F.lit(year_min), "high": F.lit(year_max)})
    w = W.partitionBy("low", "high")
    n = F.sum(F.when(F.col("before").isNull() | (F.col("before") < F.col("low")), F.col("c")).otherwise(0)).over(w)
    for _ in range((year_max - year_min + 1).bit_length()):
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        split = (F.col("n") > most) & (F.col("low") < F.col("high"))
        left = F.col("year") <= mid
        df = df.withColumn("n", n).select(
            "year", "before", "c", F.when(split & ~left, mid + 1).otherwise(F.col("low")).alias("low"),
            F.when(split & left, mid).otherwise(F.col("high")).alias("high"))
    return df.withColumn("n", n).select("low", "high", "n").distinct().orderBy("low")


def _halves(year: Column, year_min: int, year_max: int) -> Column:
    """The ranges that hold a year, from all years down to itself: array<struct<low, high>>."""
    def step(path: Column, _: Column) -> Column:
        at = F.element_at(path, -1)
        mid = F.floor((at["low"] + at["high"]) / 2)
        down = F.when(year <= mid, F.struct(at["low"].alias("low"), mid.alias("high"))).otherwise(F.struct((mid + 1).alias("low"), at["high"].alias("high")))
        return F.when(at["low"] < at["high"], F.concat(path, F.array(down))).otherwise(path)

    top = F.array(F.struct(F.lit(year_min).cast("bigint").alias("low"), F.lit(year_max).cast("bigint").alias("high")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, (year_max - year_min).bit_length()))), top, step)


def plan_chunks_sketched(dates: DataFrame, year_min: int, year_max: int, most: int, precision: int = 12) -> DataFrame:
    """The plan of plan_chunks from mergeable sketches of the items of each year: (low, high, n), n estimated.

    One sketch a year is merged into every range that halving can make of the years around it, so all counts come from one
    aggregate however often the range is halved.  A year takes the widest of its ranges that holds `most` items or fewer.  The
    standard error of a count is 1.04 / sqrt(2^precision), 1.6 % with 12.
    """
    years = dates.filter(F.col("year").between(year_min, year_max)).groupBy("year").agg(F.hll_sketch_agg("item", precision).alias("items"))
    paths = years.select("year", "items", F.posexplode(_halves(F.col("year").cast("bigint"), year_min, year_max)).alias("level", "r")).select("year", "items", "level", "r.*")
    counts = paths.groupBy("level", "low", "high").agg(F.hll_sketch_estimate(F.hll_union_agg("items")).alias("n"))
    fits = counts.filter((F.col("n") <= most) | (F.col("low") == F.col("high")))
    own = paths.select("year", "level", "low", "high").join(fits, ["level", "low", "high"])
    taken = own.groupBy("year").agg(F.min(F.struct("level", "low", "high", "n")).alias("r"))
    return taken.select("r.low", "r.high", "r.n").distinct().orderBy("low")
