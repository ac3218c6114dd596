"""Evaluation: hold-outs, negatives, ROC-AUC, silhouette, consistency over seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.functions import vectors
from affinity.operators import embedding, factors, layers, order, walks
from affinity.operators.order import drawn
from affinity.operators.session import cut

PASS_AUC = 0.7


def holdout(edges: DataFrame, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``held_out``: whether an edge falls into a share of all, by a hash of its ends and the seed; no sort, no count."""
    return edges.withColumn("held_out", drawn(F.col("src"), F.col("dst"), F.lit(seed)) < int(share * 2**32))


def negatives(edges: DataFrame, nodes: DataFrame, per_node: int, seed: int = 42, most: Column | None = None) -> DataFrame:
    """Pairs of nodes without an edge, drawn by hash: src, dst; exactly ``most`` if it is given and so many are drawn.

    Every node draws ``per_node`` of as many buckets as there are nodes, and
    every node lies in one of them, so a draw meets one other node on average;
    nothing is numbered or sorted.
    """
    n = nodes.agg(F.greatest(F.count("*"), F.lit(1)).alias("n")).scalar()
    placed = nodes.select(F.col("node").alias("other"), F.pmod(drawn(F.col("node"), F.lit("place"), F.lit(seed)), n).alias("bucket"))
    draws = nodes.select("node", F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("k"))
    draws = draws.select("node", F.pmod(drawn(F.col("node"), F.col("k"), F.lit(seed)), n).alias("bucket"))
    pairs = draws.join(placed, "bucket").where("node <> other")
    pairs = pairs.select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).distinct()
    apart = pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    if most is None:
        return apart
    return order.lowest_by_hash(apart, F.concat_ws(":", F.col("src").cast("string"), F.col("dst").cast("string"), F.lit(str(seed))), [], most)


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """ROC-AUC of a score, equals sharing their rank: auc (null without both labels), n_positive, n_negative, passed.

    Scores are counted by value first, then summed range by range of their order.
    """
    counts = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    counts = counts.select("s", "pos", (F.col("n") - F.col("pos")).alias("neg"))
    summed = order.summed_before(counts, [F.col("s")], F.col("neg"), "below")
    total = summed.agg(F.sum(F.col("pos") * (2 * F.col("below") + F.col("neg"))).alias("u2"), *[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(n) for c, n in (("pos", "n_positive"), ("neg", "n_negative"))])
    value = F.when((F.col("n_positive") > 0) & (F.col("n_negative") > 0), F.col("u2") / (2 * F.col("n_positive") * F.col("n_negative")))
    return total.select(value.alias("auc"), "n_positive", "n_negative").withColumn("passed", F.coalesce(F.col("auc") >= PASS_AUC, F.lit(False)))


def preferential_attachment(pairs: DataFrame, train: DataFrame) -> DataFrame:
    """Adds ``score``, the product of the ends' degrees in a training graph."""
    degree = layers.degrees(train)
    ends = lambda end: degree.select(F.col("node").alias(end), F.col("degree").alias(f"{end}_degree"))
    both = pairs.join(ends("src"), "src", "left").join(ends("dst"), "dst", "left")
    return both.withColumn("score", F.coalesce("src_degree", F.lit(0)) * F.coalesce("dst_degree", F.lit(0))).drop("src_degree", "dst_degree")


def cosine_scores(pairs: DataFrame, points: DataFrame, vector: str) -> DataFrame:
    """Adds ``score``, the cosine of the ends' vectors; pairs with an end that has none go."""
    ends = lambda end: points.select(F.col("node").alias(end), F.col(vector).alias(f"{end}_vector"))
    both = pairs.join(ends("src"), "src").join(ends("dst"), "dst")
    return both.withColumn("score", vectors.cosine(F.col("src_vector"), F.col("dst_vector"))).drop("src_vector", "dst_vector")


def held_out_pairs(edges: DataFrame, share: float, seed: int, per_node: int = 4) -> DataFrame:
    """Held-out edges between nodes of the training graph and as many drawn pairs without an edge: src, dst, y."""
    split = holdout(edges, share, seed)
    nodes = layers.endpoints(split.where("NOT held_out"))
    held = split.where("held_out").select("src", "dst")
    for end in ("src", "dst"):
        held = held.join(nodes.withColumnRenamed("node", end), end, "left_semi")
    apart = negatives(edges, nodes, per_node, seed, most=held.agg(F.count("*").alias("n")).scalar())
    return held.withColumn("y", F.lit(True)).unionByName(apart.withColumn("y", F.lit(False)))


def link_prediction(edges: DataFrame, tagged: DataFrame, share: float = 0.1, seed: int = 42, size: int = factors.DIMENSIONS, each: int = walks.WALKS, steps: int = walks.STEPS) -> DataFrame:
    """How well vectors trained without the held-out edges tell these from drawn pairs, beside the degrees' product.

    auc_vectors, auc_degrees, n_positive, n_negative. Pairs with an end that has no
    vector have a cosine of 0. Nodes of the walks are named by their strings.
    """
    edges = cut(edges)
    train = cut(holdout(edges, share, seed).where("NOT held_out").drop("held_out"))
    pairs = cut(held_out_pairs(edges, share, seed))
    vectors_ = cut(embedding.node_vectors(factors.token_vectors(walks.walks(train, tagged, seed, each, steps), size)))
    ends = lambda end: vectors_.select(F.col("node").alias(f"{end}_name"), F.col("vector").alias(f"{end}_vector"))
    named = pairs.withColumns({f"{end}_name": F.col(end).cast("string") for end in ("src", "dst")})
    both = named.join(ends("src"), "src_name", "left").join(ends("dst"), "dst_name", "left")
    near = both.select("y", F.coalesce(vectors.cosine(F.col("src_vector"), F.col("dst_vector")), F.lit(0.0)).alias("score"))
    by_vectors, by_degrees = auc(near, "score", "y"), auc(preferential_attachment(pairs, train), "score", "y")
    return by_vectors.select(F.col("auc").alias("auc_vectors"), "n_positive", "n_negative").withColumn("auc_degrees", by_degrees.select("auc").scalar())


def silhouette(points: DataFrame, id: str, label: str, vector: str) -> DataFrame:
    """Mean cosine silhouette over labels: label, n, silhouette.

    A mean distance to a cluster is 1 - x . sum(cluster) / size, so one sum of
    unit vectors for each label does for all pairs; the own cluster leaves the
    point itself out.
    """
    unit = points.select(F.col(id).alias("id"), F.col(label).alias("label"), vectors.scaled(F.col(vector), vectors.norm(F.col(vector))).alias("v"))
    each = unit.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    sums = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("s"))
    sizes = unit.groupBy("label").agg(F.count("*").alias("n"))
    clusters = sums.join(sizes, "label").agg(F.collect_list(F.struct("label", "s", "n")).alias("clusters"))  # one row for each label
    both = unit.withColumn("clusters", clusters.scalar())
    own = F.element_at(F.filter("clusters", lambda c: c["label"] == F.col("label")), 1)
    inner = F.when(own["n"] > 1, (own["n"] - vectors.dot(F.col("v"), own["s"])) / (own["n"] - 1))  # the own distance is 0
    others = F.transform(F.filter("clusters", lambda c: c["label"] != F.col("label")), lambda c: 1 - vectors.dot(F.col("v"), c["s"]) / c["n"])
    out = both.select("label", inner.alias("a"), F.array_min(others).alias("b"))
    out = out.select("label", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))
    return out.groupBy("label").agg(F.count("*").alias("n"), F.avg("s").alias("silhouette"))


def subset_silhouettes(points: DataFrame, id: str, vector: str, members: DataFrame) -> DataFrame:
    """The mean cosine silhouette of all points for each of several subsets against the rest: trial, silhouette.

    ``members`` has (trial, id). As in ``silhouette``, sums of unit vectors do for
    all pairs; there are as many rows as points times trials.
    """
    unit = points.select(F.col(id).alias("id"), vectors.scaled(F.col(vector), vectors.norm(F.col(vector))).alias("v"))
    own = members.select("trial", F.col(id).alias("id")).distinct()
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])
    cells = unit.select("id", F.posexplode("v").alias("i", "x"))
    whole = cells.groupBy("i").agg(F.sum("x").alias("x")).agg(listed.alias("s"))
    inner = cells.join(own, "id").groupBy("trial", "i").agg(F.sum("x").alias("x")).groupBy("trial").agg(listed.alias("s"))
    sizes = own.groupBy("trial").agg(F.count("*").alias("k"))
    trials = inner.join(sizes, "trial").agg(F.collect_list(F.struct("trial", "s", "k")).alias("t"))  # one row for each trial
    n = unit.agg(F.count("*").alias("n")).scalar()
    each = unit.withColumn("all", whole.scalar()).withColumn("n", n).withColumn("t", F.explode(trials.scalar()))
    flags = own.select("trial", "id", F.lit(True).alias("inside"))
    each = each.select("id", "v", "all", "n", F.col("t.trial").alias("trial"), F.col("t.s").alias("s"), F.col("t.k").alias("k")).join(flags, ["trial", "id"], "left")
    inside = F.coalesce("inside", F.lit(False))
    to_in, to_all = vectors.dot(F.col("v"), F.col("s")), vectors.dot(F.col("v"), F.col("all"))
    near, size = F.when(inside, to_in).otherwise(to_all - to_in), F.when(inside, F.col("k")).otherwise(F.col("n") - F.col("k"))
    a = F.when(size > 1, (size - near) / (size - 1))  # the own distance is 0
    b = F.when(F.col("n") > size, 1 - (to_all - near) / (F.col("n") - size))
    value = F.when(a.isNull() | b.isNull(), 0.0).otherwise((b - a) / F.greatest(a, b))
    return each.groupBy("trial").agg(F.avg(value).alias("silhouette"))


def random_subsets(points: DataFrame, id: str, size: Column, trials: int = 20) -> DataFrame:
    """Subsets of one exact size, drawn by hash: trial (from 1), id."""
    each = points.select(F.col(id), F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    return order.lowest_by_hash(each, F.concat_ws(":", F.col(id).cast("string"), F.col("trial").cast("string")), ["trial"], size)


def coherence(points: DataFrame, id: str, vector: str, library: DataFrame, trials: int = 20) -> DataFrame:
    """Whether a library (node) is more clustered than random subsets of its size: real, mean, sd, passed."""
    own = library.select(F.col("node").alias(id)).join(points.select(id), id, "left_semi").distinct()
    size = own.agg(F.count("*").alias("k")).scalar()
    members = own.select(F.lit(0).alias("trial"), id).unionByName(random_subsets(points, id, size, trials).select("trial", id))
    found = subset_silhouettes(points, id, vector, members)
    at = lambda c: F.when(c, F.col("silhouette"))
    out = found.agg(F.max(at(F.col("trial") == 0)).alias("real"), F.avg(at(F.col("trial") > 0)).alias("mean"), F.stddev_pop(at(F.col("trial") > 0)).alias("sd"))
    return out.withColumn("passed", F.col("real") > F.col("mean") + F.col("sd"))


def consistency(runs: DataFrame) -> DataFrame:
    """For each ordered pair in how many of the seeds' runs (seed, id, other, hit) it was hit: id, other, hits, runs."""
    return runs.groupBy("id", "other").agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.count_distinct("seed").alias("runs"))
