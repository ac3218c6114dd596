"""The cell index against a comparison of all pairs."""

import numpy as np
import pytest

from affinity.operators import neighbour_index


def data(groups, size, dim, noise, seed=1):
    rng = np.random.default_rng(seed)
    v = np.repeat(rng.normal(size=(groups, dim)), size, 0) + noise * rng.normal(size=(groups * size, dim))
    return rng.permutation(v)


def plain(v, ids, asked, k):
    unit = v / (np.sqrt((v * v).sum(1, keepdims=True)) + 1e-9)
    out = []
    for i in asked:
        cosine = np.round(unit @ unit[ids.index(i)], 12)
        order = sorted((-c, j) for c, j in zip(cosine.tolist(), ids, strict=True) if j != i)[:k]
        out += [(i, j, r + 1) for r, (_, j) in enumerate(order)]
    return sorted(out)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(neighbour_index, "BLOCK", 64)


def test_exact(spark, small_blocks):
    v = data(20, 60, 12, 0.5)
    v[5] = v[300] = v[301]  # equals are ordered by id
    ids = [int(x) for x in np.random.default_rng(2).permutation(5000)[: len(v)]]
    rows = [*zip(ids, v.tolist(), strict=True), (9000, None), (9001, [0.0] * 12)]
    points = spark.createDataFrame(rows, "id long, v array<double>").selectExpr("*", "1 AS cell", "2 AS part").repartition(3)
    index = neighbour_index.CellIndex(points, "id", "v", 10)
    assert index.points == len(v) and index.rows.count() == len(v) and max(index.parts) > 1
    asked = sorted({i for i in ids if i % 10 == 0} | {ids[5], ids[300], ids[301]})
    got = index.nearest(spark.createDataFrame([(i,) for i in [*asked, 9000, 9001, 7777]], "id long"), "id")
    assert sorted((r["id"], r["other"], r["rank"]) for r in got.collect()) == plain(v, ids, asked, 8)


@pytest.mark.parametrize("groups,size,noise,most", [(60, 50, 0.4, 0.2), (1, 2000, 1.0, 1.0)])
def test_recall(spark, groups, size, noise, most):
    """The measured number of cells reaches the wanted recall for other queries too; in groups a few cells do."""
    v = data(groups, size, 16, noise)
    ids = list(range(len(v)))
    points = spark.createDataFrame(list(zip(ids, v.tolist(), strict=True)), "id long, v array<double>")
    index = neighbour_index.CellIndex(points, "id", "v")
    probes, measured = index.probes_for(0.95)
    assert measured >= 0.95 and probes <= most * len(index.centres)
    asked = [i for i in ids if i % 20 == 0]
    got = {(r["id"], r["other"]) for r in index.nearest(points.where("id % 20 = 0"), "id", probes=probes).collect()}
    true = {(i, j) for i, j, _ in plain(v, ids, asked, 8)}
    assert len(true & got) >= 0.9 * len(true)


def test_few_points(spark):
    for rows in ([], [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, [1.0, 1.0])]):
        points = spark.createDataFrame(rows, "id long, v array<double>")
        index = neighbour_index.CellIndex(points, "id", "v")
        assert index.nearest(points, "id").count() == len(rows) * (len(rows) - 1)
        assert index.probes_for()[1] == 1.0
