"""Connected components by alternating large-star and small-star on edge tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _least(edges: DataFrame) -> DataFrame:
    """node, least: the smallest of a node and its neighbours in ``edges`` (node, other)."""
    return edges.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node's neighbourhood."""
    both = _both(edges)
    return both.join(_least(both), "node").where("other > node").select(F.col("least").alias("a"), F.col("other").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. ``a < b`` in every edge, so b is the node."""
    down = edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    least = _least(down)
    others = down.join(least, "node").select(F.col("least").alias("a"), F.col("other").alias("b"))
    return others.union(least.select(F.col("least").alias("a"), F.col("node").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node with a link.

    edges: two id columns ``a`` and ``b`` in any order; links to itself, repeated links and nulls count for nothing.
    Each round is a few joins and sums on the node, with the sums made before the shuffle; its edges are written to the
    shared folder, and only their number and a checksum reach the driver. It ends when both stars leave the edges as they are.
    """
    current = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct())
    mark = None
    while True:
        r = current.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not r["n"] or (r["n"], r["x"]) == mark:
            break
        mark = (r["n"], r["x"])
        current = written(small_star(large_star(current)))
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).union(current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
