"""Journeys and way networks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronofold.functions.text import EDGE_L, EDGE_R, WS, let, trim_all
from chronofold.operators.scans import Running, ordinals, running
from chronofold.operators.spatial import polyline_km
from chronofold.runtime import cut

# -- journeys ---------------------------------------------------------------

# Month spellings known to journey notes.
MONTH_NUMBERS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5,
    "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12}
_MONTH = ("(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|"
          "oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)")
_FRAGMENT = (rf"(?i)(?:(\d{{1,2}})(?:st|nd|rd|th)?{WS}+of{WS}+({_MONTH})\.?,?{WS}*(\d{{4}})?)"
             rf"|(?:({_MONTH})\.?{WS}+(\d{{1,2}})(?:st|nd|rd|th)?,?{WS}*(\d{{4}})?)")
_DAY_ONLY = rf"{EDGE_L}(\d{{1,2}})(?:st|nd|rd|th){EDGE_R}"
_NUMBERED = rf"^#(\d+){WS}*=(?=.*[^\s]){WS}*(.+)\z"

BLOCK = 100_000


def numbered_waypoints(features: DataFrame, path: str = "path_id", pos: str = "pos") -> DataFrame:
    """Features named '#N = place', in order of N, equal numbers in source order."""
    name = trim_all(F.coalesce("name", F.lit("")))
    number = F.regexp_extract(name, _NUMBERED, 1)
    df = features.withColumns({"number": number.try_cast("int"), "label": trim_all(F.regexp_extract(name, _NUMBERED, 2))})
    df = df.filter(F.col("number").isNotNull())
    return ordinals(df, [path], F.floor(F.col("number") / BLOCK), ["number", pos], "seq")


def date_fragment(text: Column) -> Column:
    """struct(day, month, year) of the first date-like phrase; month and year may be
    null; null when there is none."""
    months = F.create_map(*[x for k, n in MONTH_NUMBERS.items() for x in (F.lit(k), F.lit(n))])

    def read(g: Column) -> Column:
        first = g["m1"] != ""
        word = F.when(first, g["m1"]).otherwise(g["m2"])
        day = F.when(first, g["d1"]).otherwise(g["d2"])
        year = F.when(first, g["y1"]).otherwise(g["y2"])
        only = F.regexp_extract(text, _DAY_ONLY, 1)
        make = lambda d, m, y: F.struct(d.try_cast("int").alias("day"), m.alias("month"), y.try_cast("int").alias("year"))
        null = F.lit(None).cast("int")
        return F.when(word != "", make(day, F.element_at(months, F.lower(word)), year)).when(only != "", make(only, null, null))

    groups = F.struct(*[F.regexp_extract(text, _FRAGMENT, i).alias(n) for i, n in enumerate(("d1", "m1", "y1", "m2", "d2", "y2"), 1)])
    return let(groups, read)


def carry_dates(df: DataFrame, path: str, pos: str, block: int = BLOCK) -> DataFrame:
    """Resolve stated day/month/year fragments along each path.

    A stated year holds until the next one; a stated month earlier in the year
    than the month before it starts a new year.  Rows without a fragment, and rows
    before year and month are known, stay undated.

    The path is read in blocks of positions.  Inside a block everything is known
    but what came before it, so a block is summed up as: does it state a year, how
    many new years does it hold after that, and does its first month, seen against
    the month before the block, start one more.
    """
    m, y, p = F.col("stated_month"), F.col("stated_year"), F.col(pos)
    df = df.withColumn("__b", F.floor(p / block))
    keys = [path, "__b"]
    w = W.partitionBy(*keys).orderBy(pos)
    so_far, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    prior = F.last(F.when(m.isNotNull(), m), True).over(before)
    df = df.withColumn("__prior", prior)
    flag = y.isNull() & m.isNotNull() & (m < F.col("__prior"))
    df = df.withColumn("__flag", F.coalesce(flag, F.lit(False)).cast("int"))
    df = df.withColumn("__cum", F.sum("__flag").over(so_far))
    df = df.withColumns({
        "__base": F.last(F.when(y.isNotNull(), y - F.col("__cum")), True).over(so_far),
        "__said": F.last(F.when(y.isNotNull(), p), True).over(so_far),
        "__month": F.last(m, True).over(so_far)})

    at = lambda c: F.when(c.isNotNull(), p)
    s = df.groupBy(*keys).agg(
        F.min_by(F.struct(m.alias("m"), y.isNull().alias("open"), p.alias("p")), at(m)).alias("first"),
        F.max_by("__month", p).alias("month"), F.max_by("__base", p).alias("base"),
        F.max_by("__said", p).alias("said"), F.max("__cum").alias("news"))
    b = W.partitionBy(path).orderBy("__b")
    earlier = b.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("carry_m", F.last("month", True).over(earlier))
    s = s.withColumn("extra", F.coalesce(F.col("first.open") & (F.col("first.m") < F.col("carry_m")), F.lit(False)).cast("int"))
    # After a stated year the block's end year is known; else it moves the carried year on.
    stated = F.col("base").isNotNull()
    late = F.when(F.col("first.p") > F.col("said"), F.col("extra")).otherwise(0)
    s = s.withColumn("move", F.when(stated, 0).otherwise(F.col("news") + F.col("extra")))
    s = s.withColumn("moved", F.sum("move").over(b.rowsBetween(W.unboundedPreceding, 0)))
    s = s.withColumn("anchor", F.when(stated, F.col("base") + F.col("news") + late - F.col("moved")))
    s = s.withColumn("carry_y", F.last("anchor", True).over(earlier) + F.coalesce(F.last("moved").over(earlier), F.lit(0)))
    df = df.join(s.select(*keys, "carry_m", "carry_y", "extra", F.col("first.p").alias("first_p")), keys)

    counts = (F.col("extra") == 1) & (p >= F.col("first_p")) & (F.col("__said").isNull() | (F.col("__said") < F.col("first_p")))
    year = F.coalesce("__base", "carry_y") + F.col("__cum") + F.coalesce(counts, F.lit(False)).cast("int")
    month = F.coalesce("__month", "carry_m")
    known = F.col("has_fragment") & year.isNotNull() & month.isNotNull()
    out = df.withColumns({"year": F.when(known, year).cast("int"), "month": F.when(known, month).cast("int"),
                          "day": F.when(known, F.col("stated_day")).cast("int")})
    return out.drop("__b", "__prior", "__flag", "__cum", "__base", "__said", "__month", "carry_m", "carry_y", "extra", "first_p")


def day_number(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970; a day past the month's end runs on into the next."""
    return F.unix_date(F.make_date(year, month, F.lit(1))) + day - 1


def fill_gaps(df: DataFrame, path: str, pos: str, block: int = BLOCK) -> DataFrame:
    """Undated rows between two dated ones get the day in proportion to their place;
    a gap at either end of the path stays undated."""
    n = day_number(F.col("year"), F.col("month"), F.col("day"))
    df = df.withColumn("__n", n).withColumn("__b", F.floor(F.col(pos) / block))
    mark = F.when(F.col("__n").isNotNull(), F.struct(F.col(pos).alias("p"), F.col("__n").alias("n")))
    df = running(df, [path], "__b", [pos], {"__l": Running("last", mark), "__r": Running("next", mark)})
    a, b = F.col("__l"), F.col("__r")
    share = (F.col(pos) - a["p"]) / F.when(b["p"] != a["p"], b["p"] - a["p"])
    day = F.coalesce(F.col("__n"), F.floor(a["n"] + (b["n"] - a["n"]) * share).cast("int"))
    return df.withColumn("date", F.date_from_unix_date(day)).drop("__n", "__b", "__l", "__r")


def progress(day: Column, start: Column, end: Column) -> Column:
    """Share of the whole time that has passed on a day, 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.date_diff(day, start) / F.date_diff(end, start)))


def route_points(features: DataFrame, start: Column, end: Column, path: str = "path_id", pos: str = "pos") -> DataFrame:
    """(path, seq, label, lat, lng, date, t): a journey's numbered waypoints with dates
    from their descriptions, filled in between, and the share of the time passed.

    features: (path, pos, name, description, lat, lng).
    """
    df = numbered_waypoints(features, path, pos).withColumn("f", date_fragment(F.coalesce("description", F.lit(""))))
    df = df.select(path, "seq", "label", "lat", "lng", F.col("f").isNotNull().alias("has_fragment"), F.col("f.day").alias("stated_day"),
                   F.col("f.month").alias("stated_month"), F.col("f.year").alias("stated_year"))
    df = fill_gaps(carry_dates(df, path, "seq"), path, "seq")
    return df.select(path, "seq", "label", "lat", "lng", "date", progress(F.col("date"), start, end).alias("t"))


# -- way networks -----------------------------------------------------------

def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways with the coordinates of their nodes in order; missing nodes are skipped,
    ways with fewer than two points left out.

    ways: (way_id, nodes array); nodes: (node_id, lat, lng).
    """
    refs = ways.select("way_id", F.posexplode("nodes").alias("pos", "node_id"))
    line = F.sort_array(F.collect_list(F.struct("pos", "lat", "lng")))
    out = refs.join(nodes, "node_id").groupBy("way_id").agg(line.alias("l"))
    return out.filter(F.size("l") >= 2).select("way_id", F.transform("l", lambda x: F.struct(
        x["lat"].alias("lat"), x["lng"].alias("lng"))).alias("points"))


def place_key(point: Column) -> Column:
    """Two points are one place when they agree to seven decimals."""
    k = lambda c: F.floor(c * 1e7 + 0.5).cast("long")
    return F.struct(k(point["lat"]).alias("y"), k(point["lng"]).alias("x"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the connected part.

    links: (a, b).  Each round pulls every node's links to its least neighbour,
    first for larger then for smaller nodes; the rounds needed grow with the
    logarithm of the longest path.
    """
    e = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    while not _settled(e):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        e = cut(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "components")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _settled(e: DataFrame) -> bool:
    """True when each node hangs on one root and no root hangs on another."""
    roles = e.select(F.col("a").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionAll(e.select("b", F.lit(0), F.lit(1)))
    return roles.groupBy("x").agg(F.sum("hangs").alias("n"), F.max("holds").alias("h")).filter("n > 1 OR (n > 0 AND h > 0)").isEmpty()


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy chains of one network's strands: from the first unused line on, the tail
    takes the unused strand whose line is first at its place, then the head does.

    A strand is (strand, line0, p0, line1, p1): its two ends with the line that
    touches each and the number of its place.  A walk starts with the strand whose
    number is its own first line.
    """
    pdf = pdf.sort_values("strand", ignore_index=True)
    places = list(zip(pdf.p0, pdf.p1))
    at: dict[int, list[tuple[int, int, int]]] = {}
    for i, row in enumerate(zip(pdf.line0, pdf.line1)):
        for side in (0, 1):
            at.setdefault(places[i][side], []).append((row[side], i, side))
    for here in at.values():
        here.sort()
    cursor, used = dict.fromkeys(at, 0), [False] * len(places)

    def take(place: int) -> tuple[int, int]:
        here, n = at[place], cursor[place]
        while n < len(here) and used[here[n][1]]:
            n += 1
        cursor[place] = n
        return here[n][1:] if n < len(here) else (-1, 0)

    rows, name, size = [], pdf.strand.to_numpy(), pdf.size_.to_numpy()
    for first in pdf.index[pdf.starts]:
        if used[first]:
            continue
        used[first] = True
        chain, front = [(first, False)], []
        head, tail = places[first]
        while (found := take(tail))[0] >= 0:
            i, side = found
            used[i] = True
            chain.append((i, side == 1))
            tail = places[i][1 - side]
        while (found := take(head))[0] >= 0:
            i, side = found
            used[i] = True
            front.append((i, side == 0))
            head = places[i][1 - side]
        seq = 0
        for i, turned in front[::-1] + chain:
            rows.append((name[i], name[first], seq, turned))
            seq += int(size[i])
    return pd.DataFrame(rows, columns=["strand", "chain", "base", "against"])


def _ends(lines: DataFrame) -> DataFrame:
    """(end, line, y, x): an end is 2 * line for a start and 2 * line + 1 for a finish."""
    side = F.explode(F.array(F.struct((F.col("line") * 2).alias("end"), "line", F.col("sy").alias("y"), F.col("sx").alias("x")),
                             F.struct((F.col("line") * 2 + 1).alias("end"), "line", F.col("ey").alias("y"), F.col("ex").alias("x"))))
    return lines.select(side.alias("e")).select("e.*")


def _other(end: Column) -> Column:
    return end.bitwiseXOR(F.lit(1))


def _rank(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(entry, at, steps, low, headed): for each way of entering a line, the chain's
    head, how far back it is, and the least entry passed; on a closed ring there is
    no head and headed stays false.

    Each round doubles the reach: a state reads the state it has got to.
    """
    entries = lines.select(F.explode(F.array(F.col("line") * 2, F.col("line") * 2 + 1)).alias("entry"))
    back = pairs.select(F.col("end").alias("entry"), _other(F.col("partner")).alias("back"))
    headed = F.col("back").isNull()
    state = cut(entries.join(back, "entry", "left").select(
        "entry", F.coalesce("back", "entry").alias("at"), F.when(headed, 0).otherwise(1).cast("long").alias("steps"),
        F.col("entry").alias("low"), headed.alias("headed")), "rank")
    for _ in range(lines.count().bit_length() + 1):
        if state.filter("NOT headed").isEmpty():
            break
        far = state.select(F.col("entry").alias("at"), F.col("at").alias("a2"), F.col("steps").alias("s2"),
                           F.col("low").alias("l2"), F.col("headed").alias("h2"))
        state = cut(state.join(far, "at").select(
            "entry", F.col("a2").alias("at"), (F.col("steps") + F.col("s2")).alias("steps"),
            F.least("low", "l2").alias("low"), (F.col("headed") | F.col("h2")).alias("headed")), "rank")
    return state


def _strands(lines: DataFrame, ends: DataFrame) -> DataFrame:
    """(line, first, seq, turned): lines joined where exactly two ends meet.

    A strand is named by its first line and runs the way that line does; a ring opens
    where its first line starts.  The order comes from doubling jumps.
    """
    two = ends.groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"), F.min("end").alias("a"), F.max("end").alias("b")).filter("n = 2")
    pairs = cut(two.select(F.col("a").alias("end"), F.col("b").alias("partner")).unionAll(two.select("b", "a")), "pairs")
    state = _rank(lines, pairs)
    rings = state.filter("NOT headed AND low = entry AND entry % 2 = 0").select(F.col("entry").alias("end"))
    if not rings.isEmpty():
        opened = pairs.join(rings, "end", "left_anti").join(rings.select(F.col("end").alias("partner")), "partner", "left_anti")
        state = _rank(lines, opened)
    # Every strand is seen from both sides; the side on which its first line runs forward wins.
    seen = state.withColumn("line", F.floor(F.col("entry") / 2))
    first = seen.groupBy("at").agg(F.min("line").alias("first"), F.min_by(F.col("entry") % 2, "line").alias("side"))
    return seen.join(first.filter("side = 0"), "at").select(
        "line", "first", F.col("steps").alias("seq"), (F.col("entry") % 2 == 1).alias("turned"))


def merge_lines(lines: DataFrame) -> DataFrame:
    """(line, chain, seq, turned): polylines that meet end to end, as chains.

    lines: (line, points), line giving the order.  A chain is named by its first
    line and runs the way that line does.  From the first unused line on, the tail takes the
    first unused line at its place, then the head does.

    Where exactly two ends meet, that rule leaves no choice, so such lines are
    joined to strands by doubling jumps.  A strand that ends at a junction is parted where its
    first line starts, as a walk that begins there sees it, and only those parts are walked,
    network by network.  This holds at every size; the walk's task holds one row
    for each strand of a network, whatever the number of lines in it.
    """
    first, last = place_key(F.get("points", F.lit(0))), place_key(F.get("points", F.size("points") - 1))
    placed = lines.select("line", first.alias("s"), last.alias("e")).select(
        "line", F.col("s.y").alias("sy"), F.col("s.x").alias("sx"), F.col("e.y").alias("ey"), F.col("e.x").alias("ex"))
    placed = cut(placed, "line-ends")
    ends = _ends(placed)
    strands = cut(_strands(placed, ends), "strands")
    junctions = ends.groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"), F.min("end").alias("place")).filter("n > 2").select("y", "x", "place")
    # Each end at a junction, by the number of its least end.
    meeting = cut(ends.join(junctions, ["y", "x"]).select("end", "line", "place"), "meeting")
    crossed = cut(strands.join(meeting.select("line").distinct(), "line").select("first").distinct(), "crossed")
    plain = strands.join(crossed, "first", "left_anti").select("line", F.col("first").alias("chain"), F.col("seq").cast("int").alias("seq"), "turned")
    if crossed.isEmpty():
        return plain
    held = strands.join(crossed, "first")
    cutting = held.filter("line = first").select("first", F.col("seq").alias("at"))
    # Part 0 runs from the first line on, part 1 is what lies before it; both keep the strand's direction.
    parts = held.join(cutting, "first").withColumn("part", F.when(F.col("seq") >= F.col("at"), 0).otherwise(1))
    parts = parts.withColumn("pos", F.when(F.col("part") == 0, F.col("seq") - F.col("at")).otherwise(F.col("seq")))
    parts = cut(parts.withColumn("strand", F.col("first") * 2 + F.col("part")), "parts")
    bounds = parts.groupBy("strand", "first", "part").agg(
        F.count(F.lit(1)).alias("size_"), F.min_by(F.struct("line", "turned"), "pos").alias("a"), F.max_by(F.struct("line", "turned"), "pos").alias("b"))
    # The outer end of the line at either end of a part; the place of an end that is at no junction is its own.
    outer = bounds.select("strand", "first", "part", "size_", F.col("a.line").alias("line0"), F.col("b.line").alias("line1"),
                          (F.col("a.line") * 2 + F.col("a.turned").cast("int")).alias("end0"), (F.col("b.line") * 2 + 1 - F.col("b.turned").cast("int")).alias("end1"))
    place = meeting.select("end", "place")
    outer = (outer.join(place.select(F.col("end").alias("end0"), F.col("place").alias("p0")), "end0", "left")
             .join(place.select(F.col("end").alias("end1"), F.col("place").alias("p1")), "end1", "left"))
    # Where the two parts of a strand meet is the start of its first line; other free ends meet nothing.
    joint = -1 - F.col("first") * 2
    parted = bounds.filter("part = 1").select("first", F.lit(True).alias("parted"))
    outer = outer.join(parted, "first", "left").select(
        "strand", "first", "part", "size_", "line0", "line1",
        F.when((F.col("part") == 0) & F.col("parted"), joint).otherwise(F.coalesce("p0", -2 - F.col("end0") * 2)).alias("p0"),
        F.when(F.col("part") == 1, joint).otherwise(F.coalesce("p1", -2 - F.col("end1") * 2)).alias("p1"))
    outer = cut(outer, "outer")
    links = (outer.select("first", F.explode(F.array("p0", "p1")).alias("p")).filter("p >= 0").distinct())
    low = links.groupBy("p").agg(F.min("first").alias("b"))
    roots = components(links.join(low, "p").select(F.col("first").alias("a"), "b"))
    net = outer.join(roots.select(F.col("node").alias("first"), "root"), "first", "left").withColumn("root", F.coalesce("root", "first"))
    net = net.withColumn("starts", F.col("part") == 0)
    tasks = int(outer.count() / 100_000) + 8
    walked = (net.select("strand", "size_", "line0", "line1", "p0", "p1", "starts", F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("task"))
              .groupBy("task").applyInPandas(lambda pdf: _walk(pdf), "strand long, chain long, base long, against boolean"))
    size = bounds.select("strand", "size_")
    placed = parts.join(walked, "strand").join(size, "strand")
    seq = F.col("base") + F.when(F.col("against"), F.col("size_") - 1 - F.col("pos")).otherwise(F.col("pos"))
    return plain.unionAll(placed.select("line", F.floor(F.col("chain") / 2).alias("chain"), seq.cast("int").alias("seq"),
                                        (F.col("turned") != F.col("against")).alias("turned")))


def chain_lengths(lines: DataFrame, chains: DataFrame) -> DataFrame:
    """(chain, n_lines, length_km): joined lines share their ends, so lengths add up."""
    km = lines.select("line", polyline_km(F.col("points")).alias("km"))
    return chains.join(km, "line").groupBy("chain").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("km").alias("length_km"))


def chain_points(lines: DataFrame, chains: DataFrame) -> DataFrame:
    """(chain, points): whole polylines, each shared end once."""
    p = F.when(F.col("turned"), F.reverse("points")).otherwise(F.col("points"))
    part = F.when(F.col("seq") > 0, F.slice(p, 2, F.size(p))).otherwise(p)
    df = chains.join(lines, "line").groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("seq", part.alias("p")))).alias("l"))
    return df.select("chain", F.flatten(F.col("l.p")).alias("points"))


def label_sections(sections: DataFrame, group: list[str], tie: str) -> DataFrame:
    """Sections longest first, labelled 'Section 1 (812 km)'."""
    df = sections.withColumn("__neg", -F.col("length_km"))
    df = ordinals(df, group, F.floor(F.col("__neg") / 10), ["__neg", tie], "rank", 1).drop("__neg")
    km = F.floor(F.col("length_km") + 0.5).cast("long").cast("string")
    return df.withColumn("label", F.concat(F.lit("Section "), F.col("rank").cast("string"), F.lit(" ("), km, F.lit(" km)")))


def kept_share(sections: DataFrame, floor_km: float = 10.0) -> DataFrame:
    kept = F.when(F.col("length_km") >= floor_km, F.col("length_km"))
    return sections.agg(F.count(kept).alias("n_kept"), F.coalesce(F.sum(kept), F.lit(0.0)).alias("kept_km"),
                        F.sum("length_km").alias("total_km")).withColumn(
        "percent", F.col("kept_km") * 100 / F.nullif("total_km", F.lit(0.0)))
