"""Near-duplicate vectors against all pairs; the graph's recall."""

import math

import numpy as np
import pyarrow as pa
import pytest

from affinity.llm import embedding_dedup, hnsw

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, vector) by all pairs in double precision."""
    def good(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(v, w):
        v, w = (np.array(x, np.float32).astype(float) for x in (v, w))
        return v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w))

    n = len(rows)
    near = [[j for j in range(n) if j != i and good(rows[i][1]) and good(rows[j][1]) and len(rows[i][1]) == len(rows[j][1]) and (rows[i][1] == rows[j][1] or cosine(rows[i][1], rows[j][1]) >= 0.95)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return sorted(out, key=str)


def clustered(rng, groups, size, dim, noise):
    """Vectors around common centres."""
    centres = rng.normal(size=(groups, dim))
    return (np.repeat(centres, size, 0) + noise * rng.normal(size=(groups * size, dim))).astype(np.float32)


def test_dedup(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([clustered(rng, 12, 9, 16, 0.25), clustered(rng, 1, 60, 16, 0.2), rng.normal(size=(60, 16)).astype(np.float32)])
    # A chain, each near the next only.
    turn = np.zeros((12, 16), np.float32)
    turn[:, 0], turn[:, 1] = np.cos(np.arange(12) * 0.3), np.sin(np.arange(12) * 0.3)
    v = np.concatenate([v, turn])
    ids = [int(x) for x in rng.permutation(len(v))]
    rows = list(zip(ids, v.tolist(), strict=True))
    rows += [(500 + k, v[0].tolist()) for k in range(7)] + [(520, (v[1] * 4).tolist()), (521, (v[1] * 1e-30).tolist()), (522, (v[1] * 1e30).tolist())]
    rows += [(600, None), (601, []), (602, [0.0] * 16), (603, [1.0, None] * 8), (604, [float("nan")] * 16), (605, [float("inf")] + [1.0] * 15)]
    rows += [(None, v[2].tolist()), (None, [5.0] * 3), (606, [5.0] * 3), (607, [1.0, 0.0, 0.0]), (610, [1.0] * 4), (610, [-1.0] * 4), (600, [1.0] * 4), (611, [2.0])]
    table = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).selectExpr("*", "1 AS cid", "'x' AS `a.b`", "2 AS links", "3 AS h1").repartition(3)
    got = [tuple(r) for r in embedding_dedup.dedup(table).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_empty(spark):
    assert embedding_dedup.dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    got = embedding_dedup.dedup(spark.createDataFrame([(1, None, 0), (2, [0.0], 0)], SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_doubles_of_any_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1.01e-200]), (3, [1e200, -1e200])]
    got = embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


@pytest.mark.parametrize("groups,size,dim,noise", [(0, 0, 64, 0), (150, 20, 64, 0.14), (4, 900, 48, 0.16), (300, 5, 32, 0.22)])
def test_links_of_a_shard(groups, size, dim, noise):
    """Every link is found, also where a group lies at the limit, among vectors of no group."""
    rng = np.random.default_rng(groups)
    v = rng.permutation(np.concatenate([clustered(rng, groups, size, dim, noise), rng.normal(size=(3000, dim)).astype(np.float32)]))
    ids = np.arange(len(v))
    weights = 1 + ids % 3
    index = hnsw.Index(ids, weights, v)
    table = pa.table({"cid": ids, "dim": np.full(len(v), dim), "embedding": pa.array(list(v), pa.list_(pa.float32()))})
    half = table.slice(0, len(v) // 2)
    pieces = pa.table({"piece": [0], "data": [index.dump()]})
    found, links, leaf, centre, recall = embedding_dedup.search(half, pieces, 0.95)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    near = unit[: len(half)] @ unit.T >= 0.95
    want = near @ weights
    assert (found == ids[: len(half)]).all() and recall == 1.0
    assert links.sum() >= 0.999 * want.sum() and (links <= want).all()
    # Stars link what links do.
    one, other = embedding_dedup.Stars(len(v)), embedding_dedup.Stars(len(v))
    one.link(*np.nonzero(near))
    other.link(leaf, centre)
    assert (one.root != other.root).sum() <= 0.001 * len(v)


def test_the_beam_is_widened():
    """A graph searched with a beam of one misses balls; the audit doubles it until none is missed."""
    rng = np.random.default_rng(9)
    v = clustered(rng, 40, 60, 24, 0.35)
    ids = np.arange(len(v))
    index = hnsw.Index(ids, np.ones(len(v), np.int64), v)
    beam, recall = index.audit(ids, hnsw.units(v), math.acos(0.95), 1)
    assert beam > 1 and recall == 1.0
