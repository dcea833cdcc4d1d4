"""Year labels and date structs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def year_label(year: Column) -> Column:
    """-44 -> '44 BCE', 1066 -> '1066 CE'."""
    return F.when(year < 0, F.concat((-year).cast("string"), F.lit(" BCE"))) \
        .otherwise(F.concat(year.cast("string"), F.lit(" CE")))


def span_label(start: Column, end: Column) -> Column:
    return F.when(start == end, year_label(start)) \
        .otherwise(F.concat(year_label(start), F.lit(" – "), year_label(end)))


def start_date() -> Column:
    """start_date struct of a stored entry."""
    return F.struct(
        F.col("start_expr").alias("original_expression"), F.col("calendar").alias("detected_calendar"),
        "start_year", "start_month", "start_day", "end_year", "end_month", "end_day",
        "uncertainty_years")


def end_date() -> Column:
    """end_date struct; null when the entry ends in the year it starts."""
    y, m, d = F.col("end_year"), F.col("end_month"), F.col("end_day")
    return F.when(F.col("end_year") != F.col("start_year"), F.struct(
        F.col("end_expr").alias("original_expression"), F.col("calendar").alias("detected_calendar"),
        y.alias("start_year"), m.alias("start_month"), d.alias("start_day"),
        y.alias("end_year"), m.alias("end_month"), d.alias("end_day"), F.col("uncertainty_years")))


def layout_end(end_date_year: Column, own_end_year: Column) -> Column:
    """End year used for drawing: the end date's start, else the start date's own end."""
    return F.coalesce(end_date_year, own_end_year)


# English month names.
MONTHS = ["January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December"]


def long_date(year: Column, month: Column, day: Column) -> Column:
    """'December 27, 1831'."""
    name = F.get(F.array(*[F.lit(m) for m in MONTHS]), month - 1)
    return F.concat(name, F.lit(" "), day.cast("string"), F.lit(", "), year.cast("string"))


def whole_year(bound: Column) -> Column:
    """A year bound cut to a whole year, towards zero."""
    return bound.cast("int")
