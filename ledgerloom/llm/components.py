"""Connected components by alternating large and small stars: joins and minima, checkpoints between rounds.

Defined results: links of a node to itself and links with a null end are none; repeated links and either direction are one
link; no links give no rows; a node is in the result if some link has it; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._shared import cut, drop


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two links to smaller ones, or is the smaller end of one link and the larger end of another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).union(edges.select("v", F.lit(0), F.lit(1)).distinct())
    return bool(ends.groupBy("node").agg(F.sum("as_u").alias("us"), F.max("as_v").alias("vs")).where("us > 1 or us + vs > 1").head(1))


def components(links: DataFrame) -> DataFrame:
    """links (a, b), in any order and repeated -> (node, root): the smallest node of the component of each node in a link.

    A hub's links stay rows of a join and are never gathered; minima are partially aggregated.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while _unsettled(edges):
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        before, edges = edges, cut(small.select("u", F.col("low").alias("v")).union(small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))).distinct())
        drop(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
