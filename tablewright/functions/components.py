"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import checkpointed


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour, or to the node itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _down(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _down(moved.union(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that each node of an edge reaches.

    ``edges`` has two columns of one type. Rows flow along edges only; no group is ever collected, and joins on
    a node with very many edges can be split, as only one row stands on the other side. Each round is
    written to the shared checkpoint folder. Ends when a round changes nothing.
    """
    a, b = edges.columns
    now = checkpointed(_down(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20)), F.count_distinct("u")).first()
        if mark == seen or mark[0] == mark[2] and now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = mark
        now = checkpointed(_small_star(_large_star(now)))
