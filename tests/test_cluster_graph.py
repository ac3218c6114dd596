"""Graph metrics that run as joins against versions that hold the whole graph."""

import itertools
import random
from collections import defaultdict, deque

import plain_graph
import pytest

from affinity.operators import communities, shortest

EDGES = "src string, dst string, weight double"


def random_graph(seed, n, p, weights=(1, 2, 3)):
    rng = random.Random(seed)
    names = [f"n{k:02d}" for k in range(n)]
    return [(a, b, float(rng.choice(weights))) for a, b in itertools.combinations(names, 2) if rng.random() < p]


@pytest.mark.parametrize("distance", ["weight", None, "inverse"])
def test_betweenness(spark, distance):
    edges = random_graph(2, 18, 0.2, (1, 2, 4)) + [("x", "y", 1.0)]
    got = {r.node: r.betweenness for r in shortest.betweenness(spark.createDataFrame(edges, EDGES), distance).collect()}
    want = plain_graph.betweenness(edges, distance)
    assert got.keys() == want.keys()
    assert all(abs(got[v] - want[v]) < 1e-9 for v in want) and max(want.values()) > 0.1


def test_betweenness_from_pivots(spark):
    edges = random_graph(5, 60, 0.06)
    table = spark.createDataFrame(edges, EDGES)
    exact = plain_graph.betweenness(edges, "weight")
    for pivots in (15, 60):
        got = {r.node: r.betweenness for r in shortest.betweenness(table, pivots=pivots).collect()}
        assert max(abs(got[v] - exact[v]) for v in exact) <= (shortest.error(pivots) if pivots < 60 else 1e-9)


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert shortest.betweenness(none).count() == 0
    assert communities.communities(none).count() == 0
    assert shortest.path_lengths(shortest.distance_distribution(none)).first().mean_distance is None


def test_distances(spark):
    """Sketches against a search from every node: means within the sketches' error."""
    edges = random_graph(7, 90, 0.03)
    near = defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    far = []
    for v in near:
        seen, todo = {v: 0}, deque([v])
        while todo:
            x = todo.popleft()
            for y in near[x] - seen.keys():
                seen[y] = seen[x] + 1
                todo.append(y)
        far += [d for d in seen.values() if d]
    found = shortest.distance_distribution(spark.createDataFrame(edges, EDGES))
    for r in found.collect():
        want = len(near) + sum(d <= r.hops for d in far)
        assert abs(r.pairs - want) <= 0.03 * want
    got = shortest.path_lengths(found).first()
    assert abs(got.mean_distance - sum(far) / len(far)) < 0.1 and got.longest == max(far)
    last = max(d for d in range(1, max(far)) if sum(x <= d for x in far) < 0.9 * len(far))
    assert last - 0.1 <= got.effective_diameter <= last + 1.1


@pytest.mark.parametrize("seed,groups,size,inner,outer", [(1, 5, 12, 0.5, 0.03), (3, 8, 7, 0.8, 0.01)])
def test_communities(spark, seed, groups, size, inner, outer):
    """As modular as the sequential algorithm, within two percent."""
    rng = random.Random(seed)
    names = [(g, k) for g in range(groups) for k in range(size)]
    name = lambda x: f"g{x[0]}_{x[1]}"
    edges = [(name(a), name(b), float(rng.choice([1, 2]))) for a, b in itertools.combinations(names, 2) if rng.random() < (inner if a[0] == b[0] else outer)]
    table = spark.createDataFrame(edges, EDGES)
    found = communities.communities(table)
    part = {r.node: r.community for r in found.collect()}
    mine, theirs = plain_graph.modularity(edges, part), plain_graph.modularity(edges, plain_graph.louvain(edges))
    assert mine >= 0.98 * theirs
    assert abs(communities.modularity(communities.both_ways(table), found) - mine) < 1e-9
    assert set(part.values()) <= set(part)
