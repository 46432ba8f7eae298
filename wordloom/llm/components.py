"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import materialise


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a long, b long); component is the smallest node that can be reached.

    Each round links every node's larger neighbours, then its smaller ones, to
    the smallest of them (large-star and small-star); the number of rounds
    grows with the logarithm of the number of nodes.  Rounds are cut by a
    table in the shared folder.  Only the counts of edges reach the driver.
    """

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        """pairs (u, v) with v < u."""
        near = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = near.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    pairs = materialise(pairs, "links")
    for _ in range(max_rounds):
        found = materialise(stars(stars(pairs, True), False), "stars")
        # Done when every node has one smaller neighbour, which is no node's larger one.
        roots = found.select(F.col("v").alias("u")).distinct()
        loose = found.groupBy("u").count().where("count > 1").count() + found.join(roots, "u", "left_semi").count()
        pairs = found
        if not loose:
            break
    else:
        raise RuntimeError("components did not settle")
    members = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
