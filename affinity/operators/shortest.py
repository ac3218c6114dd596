"""Shortest-path metrics over the cluster: betweenness from pivots, distances by sketches.

Betweenness: every pivot's distances are relaxed in rounds of joins until none
falls. The edges on shortest paths are then known, and path counts flow out along
them round by round (all paths of one more edge at a time), and shares of paths
flow back. Rows are (pivot, node), so work and memory are spread by both.

Distances: each node has a sketch of the nodes it reaches; a round unites it with
its neighbours' sketches, so after t rounds it estimates how many lie within t
edges. The sums over all nodes give the distribution of distances.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.operators import layers
from affinity.operators.order import lowest_by_hash
from affinity.operators.session import written

MAX_ROUNDS = 10_000
#: Binary logarithm of a sketch's size: a standard error of 1.04 / sqrt(2 ** 12), 1.6 percent.
SKETCH = 12
KEYS = ["pivot", "node"]


def both_ways(edges: DataFrame, distance: str | None) -> DataFrame:
    """Edges in both directions with their length: src, dst, length; of repeated ones the shortest."""
    length = F.lit(1.0) if distance is None else F.col("weight").cast("double") if distance == "weight" else 1.0 / F.col("weight")
    own = edges.where("src <> dst").select("src", "dst", length.alias("length"))
    return own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length")).groupBy("src", "dst").agg(F.min("length").alias("length"))


def distances(ways: DataFrame, pivots: DataFrame) -> DataFrame:
    """The length of the shortest path from each pivot to each node it reaches: pivot, node, length.

    Only what fell in the last round is relaxed in the next.
    """
    known = written(pivots.select(F.col("node").alias("pivot"), "node", F.lit(0.0).alias("length"), F.lit(True).alias("fell")))
    for _ in range(MAX_ROUNDS):
        moved = known.where("fell").join(ways.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("length").alias("more")), "node")
        new = moved.groupBy("pivot", F.col("to").alias("node")).agg(F.min(F.col("length") + F.col("more")).alias("new"))
        fell = F.col("new").isNotNull() & (F.col("length").isNull() | (F.col("new") < F.col("length")))
        known = written(known.drop("fell").join(new, KEYS, "full").select(*KEYS, F.when(fell, F.col("new")).otherwise(F.col("length")).alias("length"), fell.alias("fell")))
        if known.where("fell").isEmpty():
            return known.drop("fell")
    raise RuntimeError(f"distances still fall after {MAX_ROUNDS} rounds")


def betweenness(edges: DataFrame, distance: str | None = "weight", pivots: int | None = None, seed: int = 42) -> DataFrame:
    """Normalised betweenness: node, betweenness.

    ``distance`` "weight" takes weights as lengths (strong ties are long),
    "inverse" as strengths, None counts edges. Exact with all nodes as pivots (the
    default); with so many ``pivots``, drawn by hash, each node's value is unbiased and,
    with probability 1 - d, off by at most ``error(pivots, d)``.
    """
    ways = written(both_ways(edges, distance))
    nodes = written(layers.endpoints(edges).distinct())
    n = nodes.count()
    own = nodes if pivots is None else written(lowest_by_hash(nodes, F.concat_ws(":", F.col("node").cast("string"), F.lit(str(seed))), [], F.lit(pivots)))
    count = n if pivots is None else min(pivots, n)
    far = written(distances(ways, own))
    # The edges of shortest paths, from a node to the next.
    start = far.join(ways.withColumnsRenamed({"src": "node", "dst": "next", "length": "more"}), "node")
    end = far.select("pivot", F.col("node").alias("next"), F.col("length").alias("whole"))
    steps = written(start.join(end, ["pivot", "next"]).where(F.col("length") + F.col("more") == F.col("whole")).select(*KEYS, "next"))
    paths = _flow(own.select(F.col("node").alias("pivot"), "node", F.lit(1.0).alias("x")), steps.withColumn("part", F.lit(1.0)), "node", "next")
    paths = written(paths)
    share = steps.join(paths.withColumnRenamed("x", "here"), KEYS).join(paths.withColumnsRenamed({"node": "next", "x": "there"}), ["pivot", "next"])
    share = written(share.select(*KEYS, "next", (F.col("here") / F.col("there")).alias("part")))
    # Every node but the pivot has one unit for itself and passes what it has on towards the pivot.
    back = _flow(far.where("node <> pivot").select(*KEYS, F.lit(1.0).alias("x")), share, "next", "node")
    scale = n / count / ((n - 1) * (n - 2)) if n > 2 else 1.0  # each pair is seen from both ends
    # Its own unit is none of a node's betweenness.
    through = back.where("node <> pivot").groupBy("node").agg(F.sum(F.col("x") - 1.0).alias("x"))
    return nodes.join(through, "node", "left").select("node", (F.coalesce("x", F.lit(0.0)) * scale).alias("betweenness"))


def error(pivots: int, d: float = 0.05) -> float:
    """By how much a node's value from so many pivots may be off, at most with probability d (Hoeffding's inequality; a pivot adds at most 1)."""
    return math.sqrt(math.log(2 / d) / (2 * pivots))


def _flow(start: DataFrame, links: DataFrame, source: str, target: str) -> DataFrame:
    """The sum over all rounds of what starts at nodes and flows along acyclic links in parts: pivot, node, x."""
    now = written(start)
    rounds = [now]
    for _ in range(MAX_ROUNDS):
        moved = now.withColumnRenamed("node", source).join(links, ["pivot", source])
        now = written(moved.groupBy("pivot", F.col(target).alias("node")).agg(F.sum(F.col("x") * F.col("part")).alias("x")))
        if now.isEmpty():
            break
        rounds.append(now)
    whole = rounds[0]
    for r in rounds[1:]:
        whole = whole.unionByName(r)
    return whole.groupBy(*KEYS).agg(F.sum("x").alias("x"))


def distance_distribution(edges: DataFrame, sketch: int = SKETCH) -> DataFrame:
    """How many ordered pairs of nodes are within so many edges: hops, pairs (estimates; 0 hops are the nodes themselves).

    Ends when a round adds nothing to any sketch's estimate.
    """
    own = edges.where("src <> dst")
    ways = written(own.select("src", "dst").unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    nodes = layers.endpoints(edges).distinct()
    state = written(nodes.groupBy("node").agg(F.hll_sketch_agg(F.col("node").cast("string"), sketch).alias("s")))
    rows, last = [], None
    for hops in range(MAX_ROUNDS):
        total = state.agg(F.sum(F.hll_sketch_estimate("s"))).first()[0] or 0
        if total == last:
            break
        last = total
        rows.append((hops, int(total)))
        near = ways.join(state.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "s")
        state = written(state.unionByName(near).groupBy("node").agg(F.hll_union_agg("s").alias("s")))
    return edges.sparkSession.createDataFrame(rows, "hops int, pairs long")  # a row for each hop


def path_lengths(distribution: DataFrame, share: float = 0.9) -> DataFrame:
    """From the distribution the mean distance of connected pairs, the longest, and the effective diameter: within how many edges a share of them lies, between whole numbers by a straight line."""
    rows = sorted((r["hops"], r["pairs"]) for r in distribution.collect())  # a row for each hop
    nodes = rows[0][1] if rows else 0
    within = [(h, p - nodes) for h, p in rows]
    total = within[-1][1] if within else 0
    mean = effective = None
    if total > 0:
        mean = sum(h * (p - q) for (h, p), (_, q) in zip(within[1:], within, strict=False)) / total
        for (h, q), (_, p) in zip(within, within[1:], strict=False):
            if p >= share * total:
                effective = h + (share * total - q) / (p - q)
                break
    return distribution.sparkSession.createDataFrame([(mean, effective, rows[-1][0] if total > 0 else None, total)], "mean_distance double, effective_diameter double, longest int, pairs long")

