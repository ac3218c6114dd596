"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import materialize

MAX_ROUNDS = 40


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each node of the undirected edges and the least node of its component: node, root.

    Rows are linked to ever smaller nodes until only stars around the least are
    left. Joins are on node and aggregation is partial, so a star of any size
    is spread by adaptive execution; nothing is collected but a count and a hash.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = materialize(links)
    stamp = _stamp(links)
    for _ in range(MAX_ROUNDS):
        # Large star: every larger neighbour is linked to the least of the neighbours and the node.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every smaller neighbour and the node itself are linked to the least.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        new = _stamp(links)
        if new == stamp:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        stamp = new
    raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")
