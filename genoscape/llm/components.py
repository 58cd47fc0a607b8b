"""Connected components by alternating large and small stars.

Every round is a few joins and aggregations over the edges, whose number never grows;
after a number of rounds that is about the logarithm of the longest path each node hangs
on the smallest node of its component. Nothing is collected but two sums per round; they also
say how few partitions hold a round's edges, so that many small files aren't written for few edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import cut

#: Edges that a partition holds at least, if there are as many.
EDGES = 20_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (smallest node of its component) of every node that has an edge to another."""
    now = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct())
    seen, parts = None, max(1, -(-now.count() // EDGES))
    now = now.coalesce(parts)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large stars: larger neighbours of a node are hung on its smallest
        now = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        # small stars: a node and its smaller neighbours are hung on the smallest of these
        low = now.groupBy("a").agg(F.min("b").alias("m"))
        hung = now.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(hung.unionByName(low.select("a", F.col("m").alias("b"))).distinct().coalesce(parts))
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen:
            break
        seen = tuple(sums)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
