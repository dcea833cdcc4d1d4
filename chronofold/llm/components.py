"""Distributed union-find over an edge table: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chronofold.runtime import Work


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """True when each child has one parent and no parent is a child."""
    roles = (edges.select(F.col("v").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
             .unionAll(edges.select("u", F.lit(0), F.lit(1))))
    bad = (roles.groupBy("x").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
           .where((F.col("c") > 1) | ((F.col("c") > 0) & (F.col("p") > 0))))
    return bad.isEmpty()


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star step: each node's neighbours are tied to the smallest of them.

    both_ways: all neighbours count and only larger ones are tied (large star);
    else only smaller ones count, and the node is tied too (small star).
    """
    out = edges.select(F.col("v").alias("node"), F.col("u").alias("near"))
    if both_ways:
        out = out.unionAll(edges.select("u", "v"))
    least = out.groupBy("node").agg(F.min("near").alias("m"))
    least = least.select("node", F.least("node", "m").alias("m"))
    tied = out.join(least, "node")
    if both_ways:
        return tied.where("near > node and near != m").select(F.col("near").alias("v"), F.col("m").alias("u"))
    made = tied.select(F.col("near").alias("v"), F.col("m").alias("u")).unionAll(least.select("node", "m"))
    return made.where("v != u").distinct()


def components(edges: DataFrame, work: Work) -> DataFrame:
    """(id, component) of every node with an edge; component is the smallest id reachable.

    edges: (u, v) in any order; loops and repeats are allowed, nulls are not.
    Each round is written to the shared folder, so a lost executor costs no
    more than that round.  Rounds grow with the logarithm of the longest chain.
    """
    edges = edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    first = True
    while first or not _is_forest_of_stars(edges):
        large = work.cut(_stars(edges, True), "large")
        if not first:
            work.drop(edges)
        edges, first = work.cut(_stars(large, False), "small"), False
        work.drop(large)
    return (edges.select(F.col("v").alias("id"), F.col("u").alias("component"))
            .unionAll(edges.select("u", "u").distinct()))
