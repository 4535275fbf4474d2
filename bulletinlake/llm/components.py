"""Connected components by alternating large-star and small-star rounds on an edge table.

Every round is two aggregations and joins on the edges; nothing is collected. Each round is
written to the shared folder, so the plan stays short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stash


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.a", "e.b")


def _star(directed: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours b of each node a to the smallest of them (and a)."""
    least = directed.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = directed.join(least, "a")
    if larger_only:
        out = linked.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.explode(F.array("a", "b")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of longs to ``(node, root)``: root is the smallest node reachable.

    Nodes without an edge to another node don't appear. Nulls, loops and repeated edges are
    ignored. Raises if it hasn't settled within ``max_rounds`` (log^2 of the size is usual).
    """
    now = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        large = _star(_both_ways(now), True)
        small = _star(large.where("u > v").select(F.col("u").alias("a"), F.col("v").alias("b")), False)
        now = stash(small, "edges")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
    raise RuntimeError("connected components did not settle")
