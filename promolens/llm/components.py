"""Connected components by alternating large-star and small-star rounds of joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, store


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is its least node.

    Each round hangs every neighbour on the least node it knows of; a hub's edges are rows of a
    join, never one array. Rounds are stored, so a lost executor costs one round at most.
    """
    now = store(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct(), "edges")
    while True:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(now.select(F.col("m").alias("u"), "v"))
        large = both.join(_least(both), "u").where("v > u").select("v", "m").distinct()
        down = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = _least(down)
        small = (down.join(least, "u").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
                 .where("v <> m").distinct())
        after = store(small, "edges")
        drop_stored(now)
        now = after
        # Done when no centre hangs on another node: the edges are stars.
        if now.join(now.select(F.col("v").alias("m")).distinct(), "m", "left_semi").isEmpty():
            break
    return now.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(
        now.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
