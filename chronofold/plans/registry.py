"""Registered queries and their SQL for the check tool."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronofold.plans.fixtures import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; `views` are the fixture views its SQL reads."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        run.__name__ = fn.__name__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return register


def with_views(views: tuple[str, ...], sql: str) -> str:
    """`sql` with the named fixture views in front, each after those it uses."""
    needed: list[str] = []

    def add(view: str) -> None:
        for other in SQL_VIEWS:
            if other != view and other in SQL_VIEWS[view]:
                add(other)
        if view not in needed:
            needed.append(view)

    for v in views:
        add(v)
    if not needed:
        return sql
    head = ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {head},\n{body[len('WITH'):].strip()}"
    return f"WITH {head}\n{body}"
