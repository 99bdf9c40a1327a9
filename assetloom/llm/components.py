"""Distributed union-find: connected components by alternating large-star and small-star rounds.

Each round replaces a node's edges by edges to its smallest neighbour, so paths shrink geometrically and the
edges end as stars around the smallest node of each component. A node's smallest neighbour comes from a grouped
aggregate, dealt anew and joined back, so that the edges of a node of any degree can be split over tasks.
Every round is checkpointed; nothing is collected but a number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, spread


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v) that hold both directions (large) or the one with v < u (small)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(spread(least), "u")
    out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = checkpointed(_star(_star(both, large=True), large=False))
        # Done when the edges are stars: a node points to one other at most, and what it points to points nowhere.
        ends = now.select(F.col("u").alias("n"), F.lit(1).alias("out")).unionByName(now.select(F.col("v").alias("n"), F.lit(0).alias("out")))
        odd = ends.groupBy("n").agg(F.sum("out").alias("out"), F.min("out").alias("least")).where("out > 1 OR (out = 1 AND least = 0)")
        if odd.isEmpty():
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
