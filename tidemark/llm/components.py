"""Connected components of an undirected graph, each named by its smallest node.

Large-star and small-star steps by turns: every node links its larger neighbours to its smallest one, then its smaller
neighbours and itself to its smallest one. Each step is an aggregate and a join on the node, so no neighbourhood is
gathered; the edges of each round are a stored table, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common


def _round(edges: DataFrame) -> DataFrame:
    """edges (u, v), u > v, after a large-star and a small-star step."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node with an edge to another."""
    now = common.stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while True:
        # Done when every u has one edge and no v is a u: stars around their smallest nodes.
        many = now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        chained = now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if many.select("u").unionByName(chained.select("u")).limit(1).count() == 0:
            break
        now = common.stored(_round(now), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
