"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a join and a pre-aggregated minimum, so a node with very many links
never gathers them in one task. Each round is written down, which cuts the lineage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblog.llm.common import written


def _is_forest(edges: DataFrame) -> bool:
    """True if every node has one parent and no parent has one itself: then the roots are found."""
    child = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    parent = edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    both = child.unionByName(parent).groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return both.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, root of every node in ``links`` (a, b); the root is the least node of the component."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                    "star")
    while not _is_forest(edges):
        # Large star: the larger neighbours of a node move to its least neighbour (or itself).
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "star")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
