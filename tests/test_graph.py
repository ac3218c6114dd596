"""Layers, metrics, traversals, frontiers, taxonomy and entities against plain Python on small graphs."""

import itertools
import math
import random
from collections import Counter

import plain_graph
import pytest
from pyspark.sql import functions as F

from affinity.operators import communities, dedupe, embedding, evaluate, frontier, identity, layers, metrics, traversal
from affinity.operators.walks import walks as walks_of

EDGES = "src string, dst string, weight double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def small_graph(seed=1, n=14, p=0.3):
    rng = random.Random(seed)
    names = [f"n{k:02d}" for k in range(n)]
    return [(a, b, float(rng.choice([1, 2, 3]))) for a, b in itertools.combinations(names, 2) if rng.random() < p]


def test_prune_and_normalize(spark):
    edges = spark.createDataFrame([("a", "g", "listening", 59.0), ("b", "g", "listening", 60.0), ("a", "b", "collab", 1.0), ("c", "g", "zero", 0.0)], "src string, dst string, type string, weight double")
    kept = layers.pruned(edges)
    assert {(r.src, r.type) for r in kept.collect()} == {("b", "listening"), ("a", "collab"), ("c", "zero")}
    norm = {r.type: r.norm_weight for r in layers.normalized(edges).where("dst = 'g' AND src <> 'a'").collect()}
    assert norm == {"listening": 1.0, "zero": 0.0}
    nodes = spark.createDataFrame([("a",), ("z",)], "node string")
    assert rows(layers.isolated(nodes, edges)) == [("z",)]
    assert rows(layers.connected(nodes, edges)) == [("a",)]


def test_collapse(spark):
    edges = [("a", "b", "collab", 2.0, 1), ("b", "a", "similarity", 0.5, 2), ("a", "c", "similarity", 0.4, 2), ("a", "d", "production", 1.0, 1), ("a", "d", "influence", 9.0, 1)]
    got = layers.collapse(spark.createDataFrame(edges, "src string, dst string, type string, weight double, directions int"))
    assert rows(got) == [("a", "b", "collab", 3.0), ("a", "c", "similarity", 0.4), ("a", "d", "influence", 1.0)]


def test_similarity_floor(spark):
    directed = spark.createDataFrame([("a", "b", 0.15), ("b", "a", 0.6), ("a", "c", 0.149), ("a", "a", 1.0), ("a", "x", 0.9)], "src string, dst string, match double")
    library = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert rows(layers.similarity(directed, library)) == [("a", "b", 0.6)]


def test_influence(spark):
    kind = "src string, dst string, source string"
    curated = spark.createDataFrame([("a", "b", "curated")], kind)
    generated = spark.createDataFrame([("b", "a", "llm"), ("b", "c", "llm")], kind)
    assert rows(layers.influence(curated, generated)) == [("a", "b", "curated"), ("b", "c", "llm")]
    names = spark.createDataFrame([("a", "Ann"), ("b", "Bob")], "id string, name string")
    assert rows(layers.resolved(generated, names)) == [("Bob", "Ann", "llm")]
    assert rows(layers.resolved(generated, names, False)) == [("Bob", "Ann", "llm"), ("Bob", "c", "llm")]


def test_pagerank(spark):
    edges = small_graph(2)
    near = plain_graph.neighbours(edges)
    rank = dict.fromkeys(near, 1 / len(near))
    for _ in range(200):
        rank = {v: 0.15 / len(near) + 0.85 * sum(rank[u] * w / sum(x for _, x in near[u]) for u, w in near[v]) for v in near}
    got = {r.node: r.rank for r in metrics.pagerank(spark.createDataFrame(edges, EDGES), 60, 1e-7).collect()}
    assert got == pytest.approx(rank, abs=1e-5)
    assert sum(got.values()) == pytest.approx(1)


def test_communities(spark):
    block = lambda p: [(f"{p}{a}", f"{p}{b}", 1.0) for a, b in itertools.combinations(range(6), 2)]
    edges = block("a") + block("b") + block("c") + [("a0", "b0", 1.0), ("b1", "c1", 1.0)]
    for function in (communities.communities, metrics.label_propagation):
        part = {r.node: r.community for r in function(spark.createDataFrame(edges, EDGES)).collect()}
        assert len(set(part.values())) == 3
        assert plain_graph.modularity(edges, part) > 0.55


def test_power_law(spark):
    rng = random.Random(3)
    degrees = Counter(int((2.5) * (1 - rng.random()) ** (-1 / 1.5) + 0.5) for _ in range(20000))
    fit = metrics.power_law(spark.createDataFrame(sorted(degrees.items()), "degree long, nodes long"))
    assert fit["alpha"] == pytest.approx(2.5, abs=0.12)
    assert fit["ks"] < 0.03
    assert fit["ratio"] > 0
    assert metrics._zeta(2.0, 1.0) == pytest.approx(math.pi**2 / 6)


def test_best_first(spark):
    edges = [("s", "a", 0.9), ("a", "b", 0.9), ("s", "b", 0.5), ("b", "c", 1.0), ("s", "c", 0.81), ("z", "y", 1.0)]
    seeds = spark.createDataFrame([("s",)], "node string")
    got = traversal.best_first(seeds, spark.createDataFrame(edges, "src string, dst string, match double"), 3).collect()
    assert [(r.node, round(r.priority, 4), r.depth, r.via) for r in got] == [("s", 1.0, 0, "s"), ("a", 0.9, 1, "s"), ("b", 0.81, 2, "a")]


def test_walk_to_root(spark):
    parents = [("x", 0, "music"), ("x", 1, "y"), ("y", 0, "x"), ("y", 1, "z"), ("a", 0, "genre")] + [(f"c{k}", 0, f"c{k + 1}") for k in range(9)]
    starts = spark.createDataFrame([("x",), ("a",), ("c0",), ("lone",)], "label string")
    got = {r.label: r.path for r in traversal.walk_to_root(spark.createDataFrame(parents, "child string, pos int, parent string"), starts).collect()}
    assert got == {"x": ["x", "y", "z"], "a": ["a"], "c0": [f"c{k}" for k in range(7)], "lone": ["lone"]}


def test_filters(spark):
    edges = spark.createDataFrame([("a", "b", ""), ("b", "c", "k"), ("c", "d", None)], "src string, dst string, kind string")
    assert rows(traversal.edge_selection(edges, "kind", ["", "k"])) == [("b",), ("c",)]
    near = traversal.neighbourhood(edges, spark.createDataFrame([("a",)], "node string"))
    assert rows(near) == [("a", 0), ("b", 1), ("c", 2)]
    typed = edges.withColumn("type", F.lit("influenced"))
    assert rows(traversal.lineage(typed, F.lit("a"), ["influenced"])) == [("b", 1), ("c", 2), ("d", 3)]


def test_frontier(spark):
    directed = spark.createDataFrame([("a", "x", 0.4), ("b", "x", 0.2), ("a", "b", 1.0), ("c", "y", 0.7), ("q", "z", 1.0)], "src string, dst string, match double")
    library = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    got = frontier.discovery_frontier(directed, library, spark.createDataFrame([("a",)], "node string"))
    assert [(r.node, round(r.score, 6), r.via) for r in got.collect()] == [("x", 0.8, ["a", "b"]), ("y", 0.7, ["c"])]


def test_dedupe(spark):
    entities = spark.createDataFrame(
        [("Lil Wayne", ["rap"], 2), ("Lil' Wayne", ["rap", "us"], 1), ("X, Y", ["t"], 1), ("X", [], 0), ("Y", ["u"], 3), ("P, Q", [], 1), ("P", [], 1)],
        "name string, tags array<string>, depth int",
    )
    from affinity.functions import text

    degree = spark.createDataFrame([("Lil' Wayne", 5)], "node string, in_degree long")
    picks = dedupe.canonical(entities, text.loose_key(F.col("name")), degree)
    assert {(r.name, r.winner) for r in picks.collect()} == {("Lil Wayne", "Lil' Wayne"), ("Lil' Wayne", "Lil' Wayne")}
    merged = {r.name: (r.tags, r.depth) for r in dedupe.merged(entities, dedupe.renames(picks)).collect()}
    assert merged["Lil' Wayne"] == (["rap", "us"], 1)
    assert len(merged) == 6
    assert rows(dedupe.compound_junk(entities)) == [("X, Y", ["X", "Y"])]
    gate = dedupe.gated(entities, picks).first()
    assert (gate.jaccard, gate.merge) == (0.5, True)
    refs = spark.createDataFrame([("P", "Lil Wayne", 0.3), ("P", "Lil' Wayne", 0.5), ("P", "X, Y", 0.9), ("X", "X, Y", 0.9)], "src string, dst string, match double")
    got = dedupe.rewritten(refs, dedupe.renames(picks), dedupe.compound_junk(entities))
    assert rows(got) == [("P", "Lil' Wayne", 0.5), ("P", "X", 0.9), ("P", "Y", 0.9), ("X", "Y", 0.9)]


@pytest.mark.parametrize(("a", "b", "want"), [(["x", "y"], ["y", "z"], 1 / 3), ([], ["x"], None), (["a"], ["b"], 0.0)])
def test_jaccard(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(dedupe.jaccard(F.col("a"), F.col("b")).alias("j")).first()
    assert row.j == want


def test_renames_resolve(spark):
    kind = "name string, winner string"
    got = dedupe.renames(spark.createDataFrame([("a", "b")], kind), spark.createDataFrame([("b", "c")], kind))
    assert rows(got) == [("a", "c"), ("b", "c")]


def test_identity(spark):
    def packed(title):
        return f'u\t# Track: "{title}" by "A"(spotify:artist:I1). Released on 2001-02-03. Descriptors: pop.'

    kind = "uri string, name string, played_seconds long, last_played_at string, pos int"
    top = spark.createDataFrame([("u1", packed("Song"), 100, None, 0), ("u3", "no tab", 5, None, 1)], kind)
    recent = spark.createDataFrame([("u1", packed("Other"), 7, "2024-01-02T00:00:00Z", 0), ("u2", packed("Song - Live"), 20, "2024-01-01T00:00:00Z", 1), ("u2", packed("Song - Live"), 30, None, 2)], kind)
    got = identity.tracks(top, recent).collect()
    assert len(got) == 1
    assert (got[0].track_name, got[0].played_seconds, got[0].last_played_at, got[0].is_recent, got[0].uris, got[0].decade) == ("Song", 130, "2024-01-02T00:00:00Z", True, ["u1", "u2"], 2000)


def test_auc_and_holdout(spark):
    scored = [(1.0, True), (0.5, True), (0.5, False), (0.1, False), (0.7, False)]
    want = sum((a > b) + 0.5 * (a == b) for a, x in scored for b, y in scored if x and not y) / 6
    got = evaluate.auc(spark.createDataFrame(scored, "s double, y boolean"), "s", "y").first()
    assert got.auc == pytest.approx(want)
    none = spark.createDataFrame([], "s double, y boolean")
    assert tuple(evaluate.auc(none, "s", "y").first()) == (None, 0, 0, False)  # as SQL counts
    edges = spark.createDataFrame([(f"a{k}", f"b{k}") for k in range(4000)], "src string, dst string")
    assert 0.08 < evaluate.holdout(edges).where("held_out").count() / 4000 < 0.12
    nodes = layers.endpoints(edges).limit(50)
    some = evaluate.negatives(edges, nodes, 3)
    assert some.join(edges, ["src", "dst"]).count() == 0
    assert some.count() > 60


def test_walks_and_vectors(spark):
    block = lambda p: [(f"{p}{a}", f"{p}{b}", 1.0) for a, b in itertools.combinations(range(5), 2)]
    edges = spark.createDataFrame(block("a") + block("b"), EDGES)
    tagged = spark.createDataFrame([(f"a{k}", "t") for k in range(5)] + [("lone", "u")], "node string, tag string")
    walks = walks_of(edges, tagged, each=6, steps=10).cache()
    assert walks.count() == 6 * 11
    assert {tuple(r.tokens) for r in walks.where("node = 'lone'").collect()} == {("artist::lone",)}
    again = walks_of(edges, tagged, each=6, steps=10)
    assert rows(walks) == rows(again)
    vectors = embedding.node_vectors(embedding.skip_gram(walks, size=8, epochs=3))
    pairs = spark.createDataFrame([(f"a{i}", f"a{j}", True) for i, j in itertools.combinations(range(5), 2)] + [(f"a{i}", f"b{j}", False) for i in range(5) for j in range(5)], "src string, dst string, y boolean")
    assert evaluate.auc(evaluate.cosine_scores(pairs, vectors, "vector"), "score", "y").first().auc > 0.9
    assert embedding.projected(vectors, "node", "vector").count() == 11


def test_all_steps_of_deduplication(spark):
    entities = [("Lil Wayne", ["rap"], 2), ("Lil' Wayne", ["rap", "us"], 1), ("H.E.R.", ["soul", "pop"], 1), ("Her", ["metal"], 2), ("J.J.", ["x"], 1), ("JJ", ["x"], 3), ("X", ["t"], 0), ("Y", ["u"], 3), ("X, Y", [], 1)]
    refs = [("X", "Lil Wayne", 0.4), ("Y", "X, Y", 0.7), ("X", "JJ", 0.5), ("X", "J.J.", 0.6)]
    left, rewritten, review = dedupe.deduplicated(
        spark.createDataFrame(entities, "name string, tags array<string>, depth int"), spark.createDataFrame(refs, "src string, dst string, match double")
    )
    assert {r.name for r in left.collect()} == {"Lil Wayne", "H.E.R.", "Her", "J.J.", "X", "Y"}
    assert rows(rewritten) == [("X", "J.J.", 0.6), ("X", "Lil Wayne", 0.4), ("Y", "X", 0.7)]
    assert {frozenset((r.name, r.winner)) for r in review.collect()} == {frozenset(("H.E.R.", "Her"))}
    again = dedupe.deduplicated(left, rewritten)[0]
    assert {r.name for r in again.collect()} == {r.name for r in left.collect()}


def test_clustering(spark):
    edges = small_graph(5)
    near = {v: {u for u, _ in n} for v, n in plain_graph.neighbours(edges).items()}
    linked = {frozenset((a, b)) for a, b, _ in edges}
    want = {}
    for v, around in near.items():
        k = sum(frozenset(p) in linked for p in itertools.combinations(around, 2))
        want[v] = (k, 2 * k / (len(around) * (len(around) - 1)) if len(around) > 1 else 0.0)
    got = {r.node: (r.triangles, r.coefficient) for r in metrics.clustering(spark.createDataFrame(edges, EDGES)).collect()}
    assert got == want


def test_session_vectors(spark):
    from affinity.operators import temporal

    plays = spark.createDataFrame([("u", 1, "a"), ("u", 1, "b"), ("u", 2, "a"), ("u", 2, "?")], "who string, session long, item string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "item string, vector array<double>")
    got = {r.session: r.vector for r in temporal.session_vectors(plays, "who", vectors).collect()}
    assert got == {1: [0.5, 0.5], 2: [1.0, 0.0]}
    assert temporal.with_metadata(plays, vectors).where("vector IS NULL").count() == 1
