"""Graph metrics: degree, PageRank, label propagation, degree distribution, clustering."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.operators import layers
from affinity.operators.session import cut

DAMPING = 0.85


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree over the number of other nodes: node, degree, centrality."""
    n = nodes.agg(F.count("*").alias("n")).scalar()
    out = nodes.join(layers.degrees(edges), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
    return out.withColumn("centrality", F.when(n > 1, F.col("degree") / (n - 1)).otherwise(1.0))


def pagerank(edges: DataFrame, rounds: int = 100, tolerance: float | None = 1e-6, damping: float = DAMPING, every: int = 10) -> DataFrame:
    """Weighted PageRank of an undirected graph: node, rank (summing to 1).

    With a tolerance it stops when the summed change is under it times the
    number of nodes; without, it runs all rounds. Lineage is cut now and then.
    """
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("src").agg(F.sum("weight").alias("out"))
    links = cut(both.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("p")))
    nodes = cut(layers.endpoints(edges))
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(rounds):
        moved = links.join(rank.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("in"))
        new = nodes.join(moved.withColumnRenamed("dst", "node"), "node", "left")
        new = new.select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
        if tolerance is not None or k % every == every - 1:
            new = cut(new)
        if tolerance is not None:
            change = new.join(rank.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
            if change < tolerance * n:
                return new
        rank = new
    return rank


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Communities at any size: each node takes the label of most weight around it, the least of equals: node, community.

    All nodes change at once, exactly ``rounds`` times: labels of a bipartite part may
    swap for ever, so there is no limit that they would have to reach.
    """
    both = cut(edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    labels = layers.endpoints(edges).withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        best = F.min(F.struct((-F.col("w")).alias("w"), "community"))["community"]
        labels = cut(votes.groupBy(F.col("src").alias("node")).agg(best.alias("community")))
    return labels


def degree_histogram(edges: DataFrame) -> DataFrame:
    """How many nodes have each degree: degree, nodes."""
    return layers.degrees(edges).groupBy("degree").agg(F.count("*").alias("nodes"))


def power_law(histogram: DataFrame) -> dict[str, float]:
    """A discrete power-law fit of a degree histogram (degree, nodes).

    alpha by maximum likelihood for every xmin, xmin by least Kolmogorov-Smirnov
    distance; then the log-likelihood ratio against an exponential tail with its
    two-sided p-value. The histogram has as many rows as there are degrees.
    """
    rows = sorted((int(r["degree"]), int(r["nodes"])) for r in histogram.where("degree > 0").collect())
    x, c = np.array([d for d, _ in rows], float), np.array([n for _, n in rows], float)
    best = None
    for k in range(len(x) - 1):
        tail, count = x[k:], c[k:]
        n, xmin = count.sum(), tail[0]
        alpha = 1 + n / (count * np.log(tail / (xmin - 0.5))).sum()
        model = 1 - np.array([_zeta(alpha, d + 1) for d in tail]) / _zeta(alpha, xmin)
        distance = np.abs(np.cumsum(count) / n - model).max()
        if best is None or distance < best[0]:
            best = (distance, alpha, xmin, k)
    if best is None:
        return {}
    distance, alpha, xmin, k = best
    tail, count = x[k:], c[k:]
    n = count.sum()
    mean = (tail * count).sum() / n
    rate = math.log(1 + 1 / max(mean - xmin, 1e-12))
    power = -alpha * np.log(tail) - math.log(_zeta(alpha, xmin))
    exponential = math.log(1 - math.exp(-rate)) - rate * (tail - xmin)
    diff = power - exponential
    ratio = float((diff * count).sum())
    spread = math.sqrt(max(((diff - ratio / n) ** 2 * count).sum() / n, 1e-300))
    p = math.erfc(abs(ratio) / (math.sqrt(2 * n) * spread))
    return {"alpha": float(alpha), "xmin": float(xmin), "ks": float(distance), "ratio": ratio, "p": p, "mean_degree": float((x * c).sum() / c.sum()), "nodes": float(c.sum())}


def _zeta(s: float, q: float, terms: int = 40) -> float:
    """The Hurwitz zeta function, by a sum and its Euler-Maclaurin tail."""
    k = q + np.arange(terms)
    end = q + terms
    return float((k**-s).sum() + end ** (1 - s) / (s - 1) + 0.5 * end**-s + s * end ** (-s - 1) / 12 - s * (s + 1) * (s + 2) * end ** (-s - 3) / 720)


def attached(nodes: DataFrame, *metrics: DataFrame) -> DataFrame:
    """Nodes with the columns of several metrics, all by node."""
    for m in metrics:
        nodes = nodes.join(m, "node", "left")
    return nodes


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes by kind and of edges by type: what, name, n."""
    return nodes.groupBy(F.lit("nodes").alias("what"), F.col("kind").alias("name")).agg(F.count("*").alias("n")).unionByName(
        edges.groupBy(F.lit("edges").alias("what"), F.col("type").alias("name")).agg(F.count("*").alias("n"))
    )


def top_lists(nodes: DataFrame, columns: list[str], most: int = 10, kind: str = "artist") -> DataFrame:
    """The nodes of a kind that have most of each metric: metric, rank, node, value; equals by node."""
    own = nodes.where(F.col("kind") == kind)
    parts = []
    for c in columns:
        top = own.orderBy(F.desc(c), "node").limit(most).agg(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("v"), "node"))).alias("x"))
        parts.append(top.select(F.lit(c).alias("metric"), F.posexplode("x").alias("at", "x")).select("metric", (F.col("at") + 1).alias("rank"), "x.node", (-F.col("x.v")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clustering(edges: DataFrame) -> DataFrame:
    """The local clustering coefficient: node, triangles, coefficient (0 for fewer than two neighbours).

    Edges point from the end of lower degree, so paths are few also at hubs.
    """
    degree = layers.degrees(edges)
    ends = lambda end: degree.select(F.col("node").alias(end), F.col("degree").alias(f"{end}_degree"))
    both = edges.select("src", "dst").join(ends("src"), "src").join(ends("dst"), "dst")
    forward = F.struct("src_degree", "src") < F.struct(F.col("dst_degree"), F.col("dst"))
    out = both.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("v"))
    a, b = out.withColumnRenamed("v", "x"), out.withColumnRenamed("v", "y")
    open_ = a.join(b, "u").where("x < y")
    closing = edges.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"))
    found = open_.join(closing, ["x", "y"]).select(F.explode(F.array("u", "x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    own = degree.join(found, "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    pairs = F.col("degree") * (F.col("degree") - 1)
    return own.select("node", "triangles", F.when(pairs > 0, 2 * F.col("triangles") / pairs).otherwise(0.0).alias("coefficient"))
