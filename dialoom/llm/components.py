"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import cut


def stars(state: DataFrame) -> bool:
    """Whether edges a > b are stars around the smallest ids: each a has one edge and is no other's b."""
    ends = state.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(state.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.where("up > 1 or up > 0 and down > 0").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (id, component): every node that has an edge, with the smallest id that it reaches.

    Each round is two aggregations and joins on node ids; the table is written out after each, and the
    rounds end when all are stars. Their count grows with the logarithm of the node count.
    """
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not stars(state):
        near = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = near.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        # the greater neighbours of a node, and it itself if it isn't the least, go to the least of all
        large = near.join(low, "a").select(F.greatest("a", "b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # so do its lesser ones, and it itself
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        state = cut(small.distinct())
    return state.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(state.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
