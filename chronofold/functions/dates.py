"""Dates out of infobox values and fact literals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from chronofold.functions.text import EDGE_L, EDGE_R, WS, group, let, sub, trim_all

# Month spellings known to infobox dates.
MONTH_NUMBERS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10,
    "nov": 11, "dec": 12, "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7,
    "august": 8, "september": 9, "october": 10, "november": 11, "december": 12}

# Uncertainty in years, by distance of the year from 0 and style.
UNCERTAINTY = [
    # from year, exact, circa, century, range, unknown
    (50000, 10000, 20000, 25000, 15000, 20000),
    (10000, 2000, 5000, 5000, 3000, 5000),
    (3000, 200, 500, 500, 300, 500),
    (1000, 20, 100, 100, 50, 100),
    (500, 5, 50, 50, 20, 50),
    (0, 1, 20, 50, 10, 20)]
STYLES = ["exact", "circa", "century", "range", "unknown"]

# Uncertainty in years of a fact's time precision code.
PRECISION_YEARS = {8: 5, 7: 50, 6: 500, 5: 5_000, 4: 50_000, 3: 500_000}
COARSEST_YEARS = 500_000_000

_ERA = f"{WS}*(BC|BCE|AD|CE)?"
_YEAR = r"(-?\d{1,4})"
_DAY_MONTH = rf"(?i)(\d{{1,2}}){WS}+([A-Za-z]+){WS}+{_YEAR}{_ERA}"
_MONTH_DAY = rf"(?i)([A-Za-z]+){WS}+(\d{{1,2}}),?{WS}+{_YEAR}{_ERA}"
_RANGE = rf"(?i){_YEAR}{WS}*[-–—]{WS}*{_YEAR}{_ERA}"
_CENTURY = rf"(?i)(\d{{1,2}})(?:st|nd|rd|th){WS}+century{_ERA}"
_CIRCA = rf"(?i)c\.?{WS}*(\d{{1,4}}){_ERA}"
_PLAIN = rf"(?i){_YEAR}{_ERA}"


def _template(kind: str) -> str:
    gap = rf"{WS}*\|{WS}*"
    return (rf"(?i)\{{\{{{kind}{WS}*date(?:{WS}*and{WS}*age)?{gap}(\d{{4}}){gap}(\d{{1,2}}){gap}(\d{{1,2}})")


def calendar(expr: Column) -> Column:
    s = F.lower(expr)
    return (F.when(F.regexp_like(s, F.lit(f"hijri|ah{EDGE_R}|هـ")), "islamic")
            .when(F.regexp_like(s, F.lit(f"julian|os{EDGE_R}")), "julian")
            .when(F.regexp_like(s, F.lit(f"hebrew|am{EDGE_R}")), "hebrew")
            .otherwise("gregorian"))


def style(expr: Column) -> Column:
    s = F.lower(expr)
    return (F.when(F.regexp_like(s, F.lit(rf"{EDGE_L}c\.?{WS}*\d|{EDGE_L}circa{EDGE_R}|{EDGE_L}approx")), "circa")
            .when(F.regexp_like(s, F.lit("century|millennium")), "century")
            .when(F.regexp_like(s, F.lit(rf"\d{WS}*[-–—to]{WS}*\d")), "range")
            .when(F.regexp_like(s, F.lit(r"\d{3,4}")), "exact")
            .otherwise("unknown"))


def uncertainty(year: Column, style_name: Column) -> Column:
    by_style = lambda row: F.element_at(
        F.create_map(*[x for s, n in zip(STYLES, row) for x in (F.lit(s), F.lit(n))]), style_name)
    out = None
    for low, *row in UNCERTAINTY:
        cond = F.abs(year) >= low
        out = F.when(cond, by_style(row)) if out is None else out.when(cond, by_style(row))
    return out


def _signed(year: Column, era: Column) -> Column:
    y = year.cast("int")
    return F.when(F.upper(era).isin("BC", "BCE"), -y).otherwise(y)


def _date(y, m, d, ey=None, em=None, ed=None) -> Column:
    ey, em, ed = (y, m, d) if ey is None else (ey, em, ed)
    names = ("start_year", "start_month", "start_day", "end_year", "end_month", "end_day")
    return F.struct(*[c.cast("int").alias(n) for n, c in zip(names, (y, m, d, ey, em, ed))])


def _month(word: Column) -> Column:
    months = F.create_map(*[x for k, n in MONTH_NUMBERS.items() for x in (F.lit(k), F.lit(n))])
    return F.coalesce(F.element_at(months, F.lower(word)), F.lit(0))


def _spans(e: Column) -> Column:
    """The six date numbers of a trimmed value, null when there is no date."""
    zero = F.lit(0)
    g = lambda c, pattern, i: F.regexp_extract(c, pattern, i)
    whole = None
    for kind in ("birth", "death"):
        p = _template(kind)
        hit = _date(*[g(e, p, i) for i in (1, 2, 3)])
        whole = F.when(g(e, p, 1) != "", hit) if whole is None else whole.when(g(e, p, 1) != "", hit)

    def from_prose(c: Column) -> Column:
        day_month = _date(_signed(g(c, _DAY_MONTH, 3), g(c, _DAY_MONTH, 4)), _month(g(c, _DAY_MONTH, 2)), g(c, _DAY_MONTH, 1))
        month_day = _date(_signed(g(c, _MONTH_DAY, 3), g(c, _MONTH_DAY, 4)), _month(g(c, _MONTH_DAY, 1)), g(c, _MONTH_DAY, 2))
        a, b = (_signed(g(c, _RANGE, i), g(c, _RANGE, 3)) for i in (1, 2))
        span = _date(F.least(a, b), zero, zero, F.greatest(a, b), zero, zero)
        n = g(c, _CENTURY, 1).cast("int")
        before = F.startswith(F.upper(g(c, _CENTURY, 2)), F.lit("B"))
        century = _date(F.when(before, -n * 100).otherwise((n - 1) * 100), zero, zero,
                        F.when(before, -(n - 1) * 100).otherwise(n * 100), zero, zero)
        circa = _date(_signed(g(c, _CIRCA, 1), g(c, _CIRCA, 2)), zero, zero)
        plain = _date(_signed(g(c, _PLAIN, 1), g(c, _PLAIN, 2)), zero, zero)
        out = None
        for p, d in ((_DAY_MONTH, day_month), (_MONTH_DAY, month_day), (_RANGE, span),
                     (_CENTURY, century), (_CIRCA, circa), (_PLAIN, plain)):
            out = F.when(g(c, p, 1) != "", d) if out is None else out.when(g(c, p, 1) != "", d)
        return out

    return whole.otherwise(let(trim_all(sub(sub(e, r"\{\{[^}]*\}\}"), r"\[\[[^\]]*\]\]")), from_prose))


def parse_date(value: Column) -> Column:
    """struct(expression, calendar, six numbers, uncertainty_years) or null."""
    return let(trim_all(value), lambda e: let(F.when(e != "", _spans(e)), lambda d: F.when(d.isNotNull(), F.struct(
        e.alias("expression"), calendar(e).alias("calendar"),
        *[d[n].alias(n) for n in ("start_year", "start_month", "start_day", "end_year", "end_month", "end_day")],
        uncertainty(d["start_year"], style(e)).alias("uncertainty_years")))))


def fact_time(value: Column, precision: Column) -> Column:
    """'+1815-12-10T00:00:00Z' and a precision code to year, month, day, uncertainty."""
    p = r"^[+]?(-?\d+)-(\d{2})-(\d{2})T"
    part = lambda i: F.coalesce(group(value, p, i).cast("int"), F.lit(0))
    years = F.when(precision >= 9, 0)
    for code, n in PRECISION_YEARS.items():
        years = years.when(precision == code, n)
    return F.struct(part(1).alias("year"), F.when(precision >= 10, part(2)).otherwise(0).alias("month"),
                    F.when(precision >= 11, part(3)).otherwise(0).alias("day"),
                    years.otherwise(COARSEST_YEARS).alias("uncertainty_years"))
