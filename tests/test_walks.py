"""Walks by joins against a plain walker with the same draws; factors against a dense decomposition."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinity.operators import evaluate, factors, walks

SEED = 42


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def chance(step, node, walk, *what):
    return (draw(SEED, node, walk, step, *what) + 0.5) / 2**32


def pick(items, at):
    goal, reach = at * sum(w for _, w in items), 0.0
    for item, w in items:
        reach += w
        if reach >= goal:
            return item


def choose(choices, at, name, step, node, walk, other=False):
    """Of {item: weight} one by its block and its weight in it."""
    parts = math.ceil(len(choices) / max(walks.BLOCK, math.sqrt(len(choices)))) if choices else 0
    blocks = defaultdict(list)
    for item in sorted(choices):
        if not other or item != at:
            blocks[draw(item, "block") % parts].append((item, choices[item]))
    if not blocks:
        return None
    block = pick([(b, sum(w for _, w in blocks[b])) for b in sorted(blocks)], chance(step, node, walk, name, "block"))
    return pick(blocks[block], chance(step, node, walk, name))


def plain(edges, tagged, each, steps):
    near, tags, members = defaultdict(Counter), defaultdict(dict), defaultdict(dict)
    for a, b, w in edges:
        near[a][b] += w
        near[b][a] += w
    for n, t in tagged:
        tags[n][t] = members[t][n] = 1.0
    out = []
    for node in sorted({*near, *tags}):
        for walk in range(each):
            at, tokens = node, [f"artist::{node}"]
            for step in range(1, steps + 1):
                to = None
                if tags[at] and chance(step, node, walk, "mode") < walks.TAG_SHARE:
                    tag = choose(tags[at], at, "tag", step, node, walk)
                    to = choose(members[tag], at, "other", step, node, walk, other=True)
                    if to is not None:
                        tokens.append(f"tag::{tag}")
                if to is None:
                    to = choose(near[at], at, "next", step, node, walk)
                if to is None:
                    break
                tokens.append(f"artist::{to}")
                at = to
            out.append((node, walk, tokens))
    return out


def graph():
    rng = random.Random(3)
    names = [f"n{k}" for k in range(24)]
    edges = [("hub", n, float(rng.choice([1, 2, 5]))) for n in names] + [(*rng.sample(names, 2), 1.0) for _ in range(20)]
    tagged = [(n, rng.choice("xyz")) for n in names if rng.random() < 0.7] + [("lone", "own"), ("hub", "x"), ("hub", "own2"), ("tagless end", "y")]
    return edges, tagged


def test_walks(spark, monkeypatch):
    monkeypatch.setattr(walks, "BLOCK", 5)
    edges, tagged = graph()
    e = spark.createDataFrame([*edges, ("hub", None, 1.0), ("n1", "n2", 0.0)], "src string, dst string, weight double").repartition(3)
    t = spark.createDataFrame([*tagged, tagged[0], (None, "x")], "node string, tag string")
    got = sorted((r.node, r.walk, r.tokens) for r in walks.walks(e, t, SEED, 4, 6).collect())
    want = plain(edges, tagged, 4, 6)
    assert got == want
    assert [w for n, _, w in want if n == "lone"] == [["artist::lone"]] * 4
    assert walks.walks(e.limit(0), t.limit(0), steps=2).count() == 0


def test_choices_follow_their_weights(spark, monkeypatch):
    """Draws over several blocks of a hub are in proportion to the weights."""
    monkeypatch.setattr(walks, "BLOCK", 3)
    weights = {f"b{k}": 1.0 + k % 4 for k in range(10)}
    table = walks.Choices(spark.createDataFrame([("hub", b, w) for b, w in weights.items()], "key string, item string, weight double"))
    states = spark.range(20_000).select(F.lit("hub").alias("node"), F.col("id").alias("walk"), F.lit(1).alias("step"), F.lit("hub").alias("at"))
    got = {r.to: r["count"] for r in walks.chosen(states, F.col("at"), F.lit(True), table, "to", SEED).groupBy("to").count().collect()}
    total = sum(weights.values())
    for b, w in weights.items():
        want = 20_000 * w / total
        assert abs(got[b] - want) < 5 * math.sqrt(want)


def dense(corpus, size, window=5, negatives=5):
    """Vectors by a dense singular value decomposition of the same matrix."""
    counts = Counter()
    for tokens in corpus:
        for i, a in enumerate(tokens):
            for far in range(1, window + 1):
                if i + far < len(tokens):
                    w = (window + 1 - far) / window
                    counts[a, tokens[i + far]] += w
                    counts[tokens[i + far], a] += w
    names = sorted({a for a, _ in counts})
    at = {n: k for k, n in enumerate(names)}
    n = np.zeros((len(names), len(names)))
    for (a, b), w in counts.items():
        n[at[a], at[b]] = w
    sizes = n.sum(1)
    chance = sizes**0.75 / (sizes**0.75).sum()
    with np.errstate(divide="ignore"):
        value = np.log(n / (sizes[:, None] * chance[None, :])) - math.log(negatives)
    u, s, _ = np.linalg.svd(np.maximum(value, 0))
    return names, np.maximum(value, 0), (u * np.sqrt(s))[:, :size]


@pytest.fixture(scope="module")
def blocky(spark):
    """Five groups with many edges inside and few between."""
    rng = random.Random(8)
    names = [f"{g}{k}" for g in "abcde" for k in range(24)]
    edges = [(x, y, 1.0) for i, x in enumerate(names) for y in names[i + 1 :] if rng.random() < (0.4 if x[0] == y[0] else 0.01)]
    return spark.createDataFrame(edges, "src string, dst string, weight double")


def test_factors(spark, blocky):
    corpus = walks.walks(blocky, spark.createDataFrame([], "node string, tag string"), each=4, steps=12).cache()
    names, matrix, want = dense([r.tokens for r in corpus.orderBy("node", "walk").collect()], 8)
    table = factors.shifted_pmi(factors.cooccurrences(corpus)).collect()
    assert len(table) == (matrix > 0).sum()
    assert all(abs(r.value - matrix[names.index(r.a), names.index(r.b)]) < 1e-9 for r in table)
    got = {r.token: np.array(r.vector) for r in factors.token_vectors(corpus, 8).collect()}
    assert set(got) <= set(names) and all(len(v) == 8 for v in got.values())
    mine = np.array([got.get(n, np.zeros(8)) for n in names])
    # Columns are orthogonal, their squared lengths the leading singular values, and they span as much of the matrix.
    products = mine.T @ mine
    true = (want * want).sum(0)
    assert np.abs(np.diag(products) - true).max() < 0.02 * true[0]
    assert np.abs(products - np.diag(np.diag(products))).max() < 1e-6 * true[0]
    axes = mine / np.sqrt(np.diag(products))
    assert np.linalg.norm(axes.T @ matrix) > 0.99 * np.linalg.norm((want / np.sqrt(true)).T @ matrix)


def test_link_prediction(spark, blocky):
    """Held-out edges by the cosine of vectors: as good as those of a dense decomposition, better than degrees."""
    found = evaluate.link_prediction(blocky, spark.createDataFrame([], "node string, tag string"), size=5, each=6, steps=10).first()
    split = evaluate.holdout(blocky)
    train = split.where("NOT held_out")
    corpus = walks.walks(train, spark.createDataFrame([], "node string, tag string"), each=6, steps=10)
    names, _, vectors = dense([r.tokens for r in corpus.orderBy("node", "walk").collect()], 5)
    points = spark.createDataFrame([(n.removeprefix("artist::"), v.tolist()) for n, v in zip(names, vectors, strict=True)], "node string, vector array<double>")
    pairs = evaluate.held_out_pairs(blocky, 0.1, 42)
    plain_auc = evaluate.auc(evaluate.cosine_scores(pairs, points, "vector"), "score", "y").first()
    assert abs(found.auc_vectors - plain_auc.auc) < 0.02
    assert found.auc_vectors > 0.75 > found.auc_degrees
    assert found.n_positive == plain_auc.n_positive > 10
