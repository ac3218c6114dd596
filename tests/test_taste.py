"""Genres, maps, curated graphs, crawls, orders and reports against plain Python on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinity.operators import atlas, curated, evaluate, frontier, genres, order, report, temporal, traversal
from affinity.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_genre_split(spark):
    artists = spark.createDataFrame([("a", ["x", "y", "lost"]), ("b", ["x", "x"]), ("c", ["lost"]), ("d", [])], "artist string, genres array<string>")
    seconds = spark.createDataFrame([("a", 100), ("b", 10), ("c", 7), ("d", 3)], "artist string, seconds long")
    parents = spark.createDataFrame([("x", 0, "m"), ("y", 0, "music"), ("y", 1, "n"), ("m", 0, "x")], "child string, pos int, parent string")
    known = spark.createDataFrame([("x",), ("y",)], "genre string")
    placed = genres.taxonomy(known, parents)
    assert rows(placed) == [("x", ["x", "m"], "m"), ("y", ["y", "n"], "n")]
    split = genres.split_seconds(seconds, artists, placed)
    assert rows(split) == [("x", "m", 60.0), ("y", "n", 50.0)]
    assert rows(genres.tree(split)) == [("Taste", "Taste", "", 110.0), ("genre::x", "x", "meta::m", 60.0), ("genre::y", "y", "meta::n", 50.0), ("meta::m", "m", "Taste", 60.0), ("meta::n", "n", "Taste", 50.0)]
    assert rows(genres.meta_genres(artists, placed, "artist")) == [("a", ["m", "n"]), ("b", ["m"]), ("c", []), ("d", [])]
    assert rows(genres.observed(artists)) == [("lost",), ("x",), ("y",)]


def test_atlas(spark):
    places = spark.createDataFrame([(1, 0.0, 1.0), (2, 2.0, 3.0)], "node long, x double, y double")
    edges = spark.createDataFrame([(1, 2, "curated"), (1, 9, "llm")], "src long, dst long, source string")
    assert rows(atlas.placed_edges(edges, places)) == [(1, 2, "curated", 0.0, 1.0, 2.0, 3.0)]
    tracks = spark.createDataFrame([([1, 2], 10), ([1], 30), ([7], 99)], "artist_names array<long>, played_seconds long")
    seconds = atlas.play_seconds(tracks)
    assert rows(atlas.library_overlay(places, seconds)) == [(1, 0.0, 1.0, 40, 40.0), (2, 2.0, 3.0, 10, 16.0)]
    buckets = spark.createDataFrame([(2, "rock")], "node long, bucket string")
    assert rows(atlas.background(places, buckets, seconds.where("node = 1"))) == [(2, 2.0, 3.0, "rock")]


def test_curated(spark):
    edges = spark.createDataFrame([("a", "b", "discovery_path", None), ("b", "c", "influenced", "n"), ("c", "z", "discovery_path", "why")], "src string, dst string, type string, note string")
    names = spark.createDataFrame([("a", "Ann"), ("c", "Cid")], "id string, name string")
    assert rows(curated.discovery_paths(edges, names)) == [("Ann", "b", ""), ("Cid", "z", "why")]
    scored = curated.scored_by_distance(spark.createDataFrame([("a",), ("c",), ("q",)], "node string"), edges, spark.createDataFrame([("a",)], "node string"))
    assert rows(scored) == [("a", 0, 1.0), ("c", 2, 1 / 3), ("q", None, 0.0)]
    lists = spark.createDataFrame([("p", ["a", "a", "x"]), ("q", ["c"])], "playlist string, nodes array<string>")
    assert rows(curated.playlist_scores(lists, scored)) == [("p", 2, 0.5), ("q", 1, 1 / 3)]


@pytest.mark.parametrize("stops", [[3], [5, 12], []])
def test_crawl_resumes_to_the_same(spark, tmp_path, stops):
    rng = random.Random(5)
    edges = [(a, b, rng.choice([0.25, 0.5, 1.0])) for a in range(30) for b in rng.sample(range(30), 3) if a != b]
    frame = spark.createDataFrame(edges, "src long, dst long, match double")
    seeds = spark.createDataFrame([(0,), (1,)], "node long")
    for most in stops:
        got = traversal.crawl(spark, seeds, frame, most, str(tmp_path / "state"), every=2 if most == 3 else None)
        assert got.count() == most
    (tmp_path / "state" / "universe-000099").mkdir(parents=True)  # a state that was broken off
    got = traversal.crawl(spark, seeds, frame, 20, str(tmp_path / "state"))
    assert rows(got) == rows(traversal.best_first(seeds, frame, 20))


def test_unfinished_crawls_are_errors(spark):
    chain = spark.createDataFrame([(k, k + 1, 1.0) for k in range(6)], "src long, dst long, match double")
    with pytest.raises(RuntimeError, match="still changing"):
        traversal.best_first(spark.createDataFrame([(0,)], "node long"), chain, 10, max_rounds=3)


def test_orders(spark):
    rng = random.Random(1)
    data = [(k, rng.randrange(8), rng.randrange(5)) for k in range(200)]
    frame = spark.createDataFrame(data, "id long, v int, w long")
    want, total = {}, 0
    for k, _, w in sorted(data, key=lambda r: (r[1], r[0])):
        want[k], total = total, total + w
    got = order.summed_before(frame, [F.col("v"), F.col("id")], F.col("w"), "s")
    assert {r.id: r.s for r in got.collect()} == want
    assert sorted(r.n for r in order.numbered(frame, [F.col("id")], "n").collect()) == list(range(1, 201))
    some = order.lowest_by_hash(frame, F.col("id").cast("string"), ["v"], F.lit(7))
    sizes = {v: sum(r[1] == v for r in data) for v in range(8)}
    assert {r.v: r["count"] for r in some.groupBy("v").count().collect()} == {v: min(7, n) for v, n in sizes.items()}
    assert rows(some) == rows(order.lowest_by_hash(frame.repartition(5), F.col("id").cast("string"), ["v"], F.lit(7)))


def test_nearest_is_exact_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(frontier, "BLOCK", 16)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 6))
    v[5] = v[40] = v[7]
    points = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 9)
    got = {(r.id, r["rank"]): r.other for r in frontier.nearest(points, "id", "vector", 4).collect()}
    for k in range(90):
        best = sorted((j for j in range(90) if j != k), key=lambda j: (-cosine[k, j], j))[:4]
        assert [got[k, r] for r in range(1, 5)] == best
    assert frontier.nearest(points.limit(1), "id", "vector").count() == 0


def test_silhouettes(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(24, 4))
    v[:8] += 3
    points = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>")
    library = spark.createDataFrame([(k,) for k in range(8)], "node long")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    far = 1 - unit @ unit.T
    inside = np.arange(24) < 8
    s = []
    for k in range(24):
        same = inside == inside[k]
        a, b = far[k][same].sum() / (same.sum() - 1), far[k][~same].mean()
        s.append((b - a) / max(a, b))
    got = evaluate.coherence(points, "id", "vector", library).first()
    assert math.isclose(got.real, np.mean(s), abs_tol=1e-9)
    assert got.passed and abs(got["mean"]) < 0.2
    trials = evaluate.random_subsets(points, "id", F.lit(8))
    assert {r["count"] for r in trials.groupBy("trial").count().collect()} == {8}


def test_negatives(spark):
    edges = spark.createDataFrame([(a, a + 1) for a in range(40)], "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in range(41)], "node long")
    got = evaluate.negatives(edges, nodes, 6, most=F.lit(25)).collect()
    assert len({tuple(r) for r in got}) == 25
    assert all(r.src < r.dst and r.dst - r.src > 1 for r in got)


def test_modes_and_compass(spark):
    rng = random.Random(4)
    sessions = [(k, 1, [rng.gauss(5 * (k % 3), 0.1), rng.gauss(0, 0.1)]) for k in range(30)]
    frame = spark.createDataFrame(sessions, "who long, session int, vector array<double>")
    modes = {r.who: r["mode"] for r in temporal.listening_modes(frame, 3).collect()}
    assert len({(k % 3, m) for k, m in modes.items()}) == len(set(modes.values())) == 3
    tracks = spark.createDataFrame([(0, ["club", "sad"], ["pop"], 2010), (0, ["calm", "cozy", "love"], ["pop", "latin"], 1990), (1, [], [], None)], "mode int, descriptors array<string>, macros array<string>, release_year int")
    assert rows(temporal.compass(tracks, "mode").select("mode", "energy", "valence", "era", "spread", "n")) == [(0, -0.5, 0.0, 0.5, 2, 2), (1, 0.0, 0.0, None, 0, 1)]


def test_more_like_this(spark):
    tracks = [(1, ["a"], ["pop"], 100, 2000), (2, ["a"], ["pop"], 90, 2001), (3, ["b"], ["rock"], 100, 2000), (4, [], [], 0, None)]
    frame = spark.createDataFrame(tracks, "id long, descriptors array<string>, macros array<string>, played_seconds long, release_year int")
    got = {(r.id, r["rank"]): r.other for r in frontier.more_like(frame, "id", ["a", "b"], ["pop", "rock"]).collect()}
    assert (got[1, 1], got[2, 1]) == (2, 1)


def test_reports(spark):
    notes = spark.createDataFrame([("AC DC", "---\nname: x\n---\nB"), ("Nobody", "plain")], "stem string, content string")
    artists = spark.createDataFrame([("AC/ DC", ["rock"], []), ("AC: DC", ["pop"], ["t"])], "name string, meta_genres array<string>, lastfm_tags array<string>")
    assert rows(report.enriched_notes(notes, artists)) == [("AC DC", "---\nname: x\nmeta_genres: [rock]\n---\nB"), ("Nobody", "plain")]
    one = spark.createDataFrame([("A\n\n## Say (what)\n\nold\n",)], "t string").select(report.section_upserted(F.col("t"), "Say (what)", F.lit("new"))).first()[0]
    assert one == "A\n\n## Say (what)\n\nnew\n"
    link = spark.createDataFrame([(0.91, 12, True)], "auc double, n_positive long, passed boolean")
    gate = spark.createDataFrame([(0.01, 0.0, 0.002, True)], "real double, mean double, sd double, passed boolean")
    runs = spark.createDataFrame([("a", "b", 1, 2)], "id string, other string, hits long, runs long")
    lines = [r.line for r in report.check_lines(link, gate, spark.createDataFrame([("z",)], "node string"), runs).orderBy("pos").collect()]
    assert lines[0] == "1. Link prediction: AUC 0.910 over 12 held-out edges; passes"
    assert lines[1].endswith("more clustered than random") and lines[2:] == ["3. Isolated nodes: 1", "4. a → b: 1/2"]


def test_json_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")
    assert files.json_map(frame, "k").first()[0] == '{"a":{"v":1},"b":{"v":2}}'
    assert "\n" in files.json_map(frame, "k", pretty=True).first()[0]
    files.write_json(frame.select("v", "k"), str(tmp_path / "j"), single=True, sorted_keys=True)
    assert sorted(spark.read.text(str(tmp_path / "j")).toPandas()["value"]) == ['{"k":"a","v":1}', '{"k":"b","v":2}']
    points = spark.createDataFrame([("n", [1.0, 2.0])], "node string, vector array<double>")
    files.write_matrix(points, str(tmp_path / "m"))
    assert rows(spark.read.parquet(str(tmp_path / "m"))) == [("n", [1.0, 2.0])]
