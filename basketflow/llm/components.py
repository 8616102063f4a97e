"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.session import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, component) of every node that has an edge; the component is its smallest node.

    ``edges`` has long columns a and b.  Each round points the larger
    neighbors of a node at its smallest one (large star), then the smaller
    ones (small star), until every edge leads from a node with no other edge
    to its component: a logarithmic number of rounds in practice.  A node with
    a great many edges is one join key of the round; adaptive execution splits
    it.  Nothing leaves the cluster but one row per round.  Nulls and loops
    are no edges.
    """
    current = scratch.settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        following = scratch.settle(small.where("a <> b").distinct())
        scratch.drop(current)
        current = following
        ends = F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
        nodes = current.select(ends).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if nodes.where("up > 1 OR up = 1 AND down = 1").isEmpty():
            break
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())
