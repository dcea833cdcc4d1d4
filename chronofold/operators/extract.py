"""From pages with infoboxes to entries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chronofold.functions.coords import LOCATION_MAP, page_points
from chronofold.functions.dates import parse_date
from chronofold.functions.text import WS, description, slug
from chronofold.operators.catalog import DEFAULT_TYPES, category_of, infobox_types, primary_type
from chronofold.runtime import keep_if

# Infobox fields that date an entry, by category, best first.
# A # stands for an optional number at the end of the name.
DATE_FIELDS = {
    "person": "birth_date death_date date start_date# end_date#",
    "event": "date event_date start_date# end_date# date_start date_end year_start year_end",
    "place": "founded inception established_date# established dissolved year_start year_end",
    "artifact": "ship_commissioned ship_launched ship_laid_down ship_decommissioned commissioned launched"
                " laid_down decommissioned introduced date_introduced year_introduced manufactured"
                " date_manufactured completed date_completed production_date inception date",
    "other": "date birth_date death_date start_date# end_date# founded established_date# established"
             " inception dissolved",
}
_NUMBERED = r"^(start_date|end_date|established_date)\d*\z"

_FIELD = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
TEMPLATES = T.StructType([T.StructField("fields", T.ArrayType(_FIELD)), T.StructField("maps", T.ArrayType(T.StringType()))])
_MARK = re.compile(r"\{\{|\}\}")
_STEP = re.compile(r"\{\{|\}\}|\|")
_BOX = re.compile(r"\{\{\s*[Ii]nfobox(?![0-9A-Za-z_])")
_MAP = re.compile(r"\{\{\s*[Ll]ocation map")
_KEY = re.compile(r"\|\s*([A-Za-z_0-9]+)\s*=\s*")
_PLAIN = re.compile(r"[^\n|}{\[\]]+")


def _close(text: str, start: int) -> int:
    """End of the template that opens at `start`; -1 when it never closes."""
    depth = 0
    for m in _MARK.finditer(text, start):
        depth += 1 if m[0] == "{{" else -1
        if depth == 0:
            return m.end()
    return -1


def _box_fields(body: str) -> Iterator[tuple[str, str]]:
    depth, at, seen = 0, 0, set()
    while m := _STEP.search(body, at):
        at = m.end()
        if m[0] == "{{":
            depth += 1
        elif m[0] == "}}":
            depth -= 1
            if depth <= 0:
                return
        elif depth == 1 and (k := _KEY.match(body, m.start())) and k[1].lower() not in seen:
            seen.add(k[1].lower())
            if body.startswith("{{", k.end()):
                end = _close(body, k.end())
                value, at = (body[k.end():end], end) if end > 0 else ("", len(body))
            else:
                p = _PLAIN.match(body, k.end())
                value, at = (p[0], p.end()) if p else ("", k.end())
            yield k[1].lower(), value.strip()


@F.pandas_udf(TEMPLATES)
def page_templates(text: pd.Series) -> pd.DataFrame:
    """Top-level infobox fields (first of each name) and locator-map bodies.

    Nesting depth is the one thing regular expressions cannot follow, so this
    is the only step on pages that leaves the JVM.
    """
    fields, maps = [], []
    for t in text:
        found: dict[str, str] = {}
        for m in _BOX.finditer(t or ""):
            end = _close(t, m.start())
            for k, v in _box_fields(t[m.start():end]) if end > 0 else ():
                found.setdefault(k, v)
        ends = [(m.start(), _close(t, m.start())) for m in _MAP.finditer(t or "")]
        fields.append([{"key": k, "value": v} for k, v in found.items()])
        maps.append([t[a:b] for a, b in ends if b > 0])
    return pd.DataFrame({"fields": fields, "maps": maps})


def needs_templates(wikitext: Column) -> Column:
    """The text where it has such templates, else null: nothing to send to Python."""
    return F.when(F.regexp_like(wikitext, F.lit(rf"\{{\{{{WS}*[Ii]nfobox|{LOCATION_MAP}")), wikitext)


def entry_dates(fields: Column, category: Column) -> Column:
    """struct(start, end) of parsed dates.

    For each field name of the category, best first, the first field with that
    name that holds a date; equal start years count once; the last one is the
    end unless it lies before the start.
    """
    names = {c: [n.rstrip("#") for n in listing.split()] for c, listing in DATE_FIELDS.items()}
    wanted = sorted({n for ns in names.values() for n in ns})
    keyed = F.transform(fields, lambda f: F.struct(F.regexp_replace(f["key"], _NUMBERED, "$1").alias("key"), f["value"].alias("value")))
    dated = F.filter(F.transform(F.filter(keyed, lambda f: f["key"].isin(*wanted)), lambda f: F.struct(
        f["key"].alias("key"), parse_date(f["value"]).alias("date"))), lambda f: f["date"].isNotNull())
    lists = F.create_map(*[x for c, ns in names.items() for x in (F.lit(c), F.array(*[F.lit(n) for n in ns]))])
    keys = F.coalesce(F.element_at(lists, category), F.element_at(lists, F.lit("other")))

    def pick(ds: Column) -> Column:
        hits = F.filter(F.transform(keys, lambda k: F.get(F.filter(ds, lambda d: d["key"] == k), F.lit(0))["date"]),
                        lambda d: d.isNotNull())
        unique = F.filter(hits, lambda d, i: ~F.exists(F.slice(hits, 1, i), lambda e: e["start_year"] == d["start_year"]))
        return F.element_at(F.transform(F.array(unique), ends), 1)

    def ends(u: Column) -> Column:
        first, last = F.get(u, F.lit(0)), F.get(u, F.size(u) - 1)
        return F.struct(first.alias("start"), F.when(
            (F.size(u) > 1) & (last["start_year"] >= first["start_year"]), last).alias("end"))

    return F.element_at(F.transform(F.array(dated), pick), 1)


@dataclass(frozen=True)
class IngestRules:
    """What a page must satisfy to become an entry."""

    include: list[str] = field(default_factory=lambda: list(DEFAULT_TYPES))
    exclude_categories: list[str] = field(default_factory=list)
    require_points: bool = False
    date_after: int | None = None
    date_before: int | None = None
    max_start_year: dict[str, int] = field(default_factory=dict)


def judge_pages(pages: DataFrame, rules: IngestRules = IngestRules()) -> DataFrame:
    """Pages with an included infobox type, what was found on them and why they
    fall out (reject_reason, null for a kept page).

    The type and category tests come first; text already rejected is not sent
    to Python or searched for points and dates.
    """
    df = pages.withColumn("infobox_type", primary_type(infobox_types(F.col("wikitext")), rules.include))
    df = keep_if(df, F.col("infobox_type").isNotNull()).withColumn("category", category_of(F.col("infobox_type")))
    out = F.col("category").isin(*rules.exclude_categories) if rules.exclude_categories else F.lit(False)
    df = df.withColumn("live", F.when(~out, F.col("wikitext")))
    df = df.withColumn("templates", page_templates(needs_templates(F.col("live"))))
    maps = F.coalesce(F.col("templates.maps"), F.array().cast("array<string>"))
    df = df.withColumn("points", F.when(F.col("live").isNotNull(), page_points(F.col("live"), maps)))
    df = df.withColumn("dates", entry_dates(F.col("templates.fields"), F.col("category")))
    year = F.col("dates.start.start_year")
    reason = F.when(F.col("live").isNull(), "category")
    if rules.require_points:
        reason = reason.when(F.size("points") == 0, "no coordinates")
    reason = reason.when(year.isNull(), "no start date")
    if rules.date_after is not None:
        reason = reason.when(year < rules.date_after, "before range")
    if rules.date_before is not None:
        reason = reason.when(year > rules.date_before, "after range")
    for infobox_type, cap in rules.max_start_year.items():
        reason = reason.when((F.col("infobox_type") == infobox_type) & (year > cap), "over year cap")
    return df.withColumn("reject_reason", reason).drop("live", "templates")


def extract_entries(judged: DataFrame, opening: int | None = None, most: int | None = None) -> DataFrame:
    """Kept pages as entries; opening and most cut the description, if given."""
    s, e = F.col("dates.start"), F.col("dates.end")
    point = lambda p: F.struct(F.lit("point").alias("type"), p["lat"].alias("lat"), p["lng"].alias("lng"))
    end = lambda part: F.when(e.isNotNull(), e[f"start_{part}"]).otherwise(s[f"end_{part}"]).alias(f"end_{part}")
    return keep_if(judged, F.col("reject_reason").isNull()).select(
        slug(F.col("title")).alias("id"), "title", F.transform("points", point).alias("locations"),
        s["start_year"].alias("start_year"), s["start_month"].alias("start_month"), s["start_day"].alias("start_day"),
        end("year"), end("month"), end("day"),
        s["expression"].alias("start_expr"), F.coalesce(e["expression"], s["expression"]).alias("end_expr"),
        s["calendar"].alias("calendar"), s["uncertainty_years"].alias("uncertainty_years"),
        "category", "infobox_type", description(F.col("wikitext"), opening, most).alias("description"),
        F.when(F.size("points") == 0, F.array(F.lit("no-coords-found")))
        .otherwise(F.array().cast("array<string>")).alias("tags"))
