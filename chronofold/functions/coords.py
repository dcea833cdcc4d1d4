"""Coordinates out of page markup and fact literals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from chronofold.functions.text import WS, leading_float, let, strict_number, trim_all

POINT = "struct<lat:double,lng:double>"
COORD = rf"\{{\{{{WS}*[Cc]oord{WS}*\|(?=([\s\S]*?)\}}\}})"
COORD_MODULE = rf"(?i)\{{\{{{WS}*#invoke:{WS}*Coordinates{WS}*\|{WS}*coord{WS}*\|(?=([\s\S]*?)\}}\}})"
LOCATION_MAP = rf"\{{\{{{WS}*[Ll]ocation map"

# Points this close in latitude are taken for the same place.
SAME_LATITUDE = 0.0001


def _point(lat: Column, lng: Column) -> Column:
    return F.when(lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng")))


def _degrees(numbers: Column, negative: Column) -> Column:
    """Degrees, minutes and seconds to signed degrees; null when there is none."""
    d = (F.get(numbers, F.lit(0)) + F.coalesce(F.get(numbers, F.lit(1)), F.lit(0.0)) / 60
         + F.coalesce(F.get(numbers, F.lit(2)), F.lit(0.0)) / 3600)
    return F.when(negative, -d).otherwise(d)


def _numbers(parts: Column) -> Column:
    return F.filter(F.transform(parts, strict_number), lambda n: n.isNotNull())


def coord_arguments(raw: Column) -> Column:
    """Arguments of a coordinate template to a point: with hemisphere letters as
    degrees, minutes, seconds; without them the first two numbers."""
    parts = F.filter(F.transform(F.split(raw, r"\|"), trim_all),
                     lambda s: (s != "") & ~F.regexp_like(s, F.lit("[:=]")))

    def read(p: Column) -> Column:
        at = lambda letters: F.array_position(F.transform(p, lambda s: F.regexp_like(s, F.lit(rf"^[{letters}]\z"))), True).cast("int")
        return let(F.struct(p.alias("p"), at("NSns").alias("ns"), at("EWew").alias("ew")), hemisphere)

    def hemisphere(x: Column) -> Column:
        p, ns, ew = x["p"], x["ns"], x["ew"]
        south = F.upper(F.get(p, ns - 1)) == "S"
        west = F.upper(F.get(p, ew - 1)) == "W"
        lat = _degrees(_numbers(F.slice(p, 1, ns - 1)), south)
        lng = _degrees(_numbers(F.slice(p, ns + 1, F.greatest(ew - ns - 1, F.lit(0)))), west)
        return F.when((ns > 0) & (ew > 0), _point(lat, lng)).otherwise(
            let(_numbers(p), lambda n: _point(F.get(n, F.lit(0)), F.get(n, F.lit(1)))))

    return let(parts, read)


def _field(text: Column, name: str, value: str) -> Column:
    return F.regexp_extract(text, rf"(?i)\|{WS}*{name}{WS}*={WS}*({value})", 1)


def _or(c: Column, default: str) -> Column:
    return F.when(c != "", c).otherwise(default)


def degree_fields(text: Column) -> Column:
    """The lat_deg / lon_deg family of fields."""
    def side(axis: str, letters: str, negative: str, default: str) -> Column:
        n = lambda part: leading_float(_or(_field(text, f"{axis}_?{part}", r"[\d.]+"), "0"))
        deg = leading_float(_field(text, f"{axis}_?deg", r"-?[\d.]+"))
        d = deg + n("min") / 60 + n("sec") / 3600
        toward = _or(_field(text, f"{axis}_?[{letters}][{'Ss' if default == 'N' else 'Ww'}]",
                            "[SsNn]" if default == "N" else "[EeWw]"), default)
        return F.when(F.upper(toward) == negative, -d).otherwise(d)
    return _point(side("lat", "Nn", "S", "N"), side("lo(?:n|ng)", "Ee", "W", "E"))


def plain_fields(text: Column) -> Column:
    """latitude = and longitude = as plain decimals."""
    n = lambda name: leading_float(_field(text, name, r"-?[\d.]+"))
    return _point(n("latitude"), n("longitude"))


def map_mark(body: Column) -> Column:
    """lat = and long = inside one locator-map template."""
    num = r"(-?\d+(?:\.\d+)?)"
    n = lambda name: F.regexp_extract(
        body, rf"(?i)\|{WS}*{name}{WS}*={WS}*{num}{WS}*(?:\||\}}|\n)", 1).try_cast("double")
    return _point(n("lat(?:itude)?"), n("lo(?:n|ng)(?:gitude)?"))


def distinct_points(points: Column, strict: bool = False) -> Column:
    """Valid points in order; one whose latitude is that of an earlier point is
    dropped.  strict=True compares the longitude as well."""
    valid = F.filter(points, lambda p: p.isNotNull() & (F.abs(p["lat"]) <= 90) & (F.abs(p["lng"]) <= 180)
                     & ~F.isnan(p["lat"]) & ~F.isnan(p["lng"]))

    def same(a: Column, b: Column) -> Column:
        near = F.abs(a["lat"] - b["lat"]) < SAME_LATITUDE
        return near & (F.abs(a["lng"] - b["lng"]) < SAME_LATITUDE) if strict else near

    return F.aggregate(valid, F.array().cast(f"array<{POINT}>"), lambda kept, p: F.when(
        F.exists(kept, lambda k: same(k, p)), kept).otherwise(F.concat(kept, F.array(p))))


def page_points(text: Column, map_bodies: Column, strict: bool = False) -> Column:
    """All points of a page, by the five forms in order."""
    return distinct_points(F.concat(
        F.transform(F.concat(F.regexp_extract_all(text, F.lit(COORD), F.lit(1)),
                             F.regexp_extract_all(text, F.lit(COORD_MODULE), F.lit(1))), coord_arguments),
        F.transform(map_bodies, map_mark),
        F.array(degree_fields(text), plain_fields(text))), strict)


def wkt_point(wkt: Column) -> Column:
    """'POINT(lng lat)' to a point, else null."""
    p = rf"(?i)^{WS}*POINT\({WS}*(-?[\d.]+{WS}+-?[\d.]+){WS}*\){WS}*\z"
    # What is a number as a whole is what its leading number is.
    number = lambda n: F.coalesce(n.try_cast("double"), leading_float(n))
    pair = let(F.split(F.regexp_extract(wkt, p, 1), rf"{WS}+"), lambda s: F.transform(s, number))
    return let(pair, lambda n: _point(F.get(n, F.lit(1)), F.get(n, F.lit(0))))
