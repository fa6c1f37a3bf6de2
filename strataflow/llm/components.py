"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm._shared import discard, materialize, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(near: DataFrame, keep) -> DataFrame:
    """Each node's neighbours that `keep` selects are linked to the node's least neighbour instead."""
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    moved = near.join(least, "a").where(keep).select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of undirected links (a long, b long): one row (node, root) for each node, root its least node.

    Every round is a partial aggregation and a join of the links that are left, written to the shared
    folder. The number of rounds grows with the logarithm of the longest chain. Null ends and loops are
    ignored; an empty table gives no rows.
    """
    spark, before = edges.sparkSession, written()
    links = materialize(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        found = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if not found["n"] or (found["n"], found["s"]) == state:
            break
        state = (found["n"], found["s"])
        large = _star(_both_ways(links), F.col("b") > F.col("a")).where("a <> b").distinct()
        # after a large star every link points from a node to a lesser one
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(least.select("a", F.col("root").alias("b")))
        links = materialize(small.where("a <> b").distinct(), "links")
        discard(spark, before, keep=1)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
