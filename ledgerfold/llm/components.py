"""Connected components of a stored edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored


def _are_stars(edges: DataFrame) -> bool:
    """Whether each edge leads from a node that has no other edge to one that no edge leads from."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("leaves")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("leaves")))
    by_node = ends.groupBy("node").agg(F.sum("leaves").alias("out"), F.count(F.lit(1)).alias("all"))
    return by_node.where((F.col("out") > 1) | (F.col("out") == 1) & (F.col("all") > 1)).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest one."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; edges has columns a and b, root is the smallest node reachable.

    The edge list is rewritten until it is a set of stars; each round is stored,
    the driver only sees whether it is one.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stored(edges.where("a <> b").select(larger, smaller).distinct())
    while not _are_stars(edges):
        edges = stored(_small_star(_large_star(edges)))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
