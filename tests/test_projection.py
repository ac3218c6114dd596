"""The projection by neighbours against principal components."""

import numpy as np

from affinity.operators import embedding, factors, frontier


def kept(v, at, k=8):
    """The share of each point's k nearest that are among its k nearest in the projection."""

    def nearest(x):
        far = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
        np.fill_diagonal(far, np.inf)
        return np.argsort(far, 1)[:, :k]

    return np.mean([len(set(a) & set(b)) / k for a, b in zip(nearest(v).tolist(), nearest(at).tolist(), strict=True)])


def test_neighbours_are_kept(spark):
    """A closed curve through many dimensions: its plane of largest spread crosses itself, its waves don't."""
    rng = np.random.default_rng(6)
    t = np.sort(rng.uniform(0, 2 * np.pi, 160))
    v = np.concatenate([[np.cos(m * t), np.sin(m * t)] for m in (2, 3, 5, 7)]).T
    points = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = frontier.nearest(points, "id", "v").select("id", "other")
    ordered = lambda d: np.array([r["at"] for r in d.orderBy("id").collect()])
    waves, plane = kept(unit, ordered(factors.neighbour_projection(near))), kept(unit, ordered(embedding.projected(points, "id", "v")))
    assert waves > 0.7 and waves > plane + 0.2
    assert factors.neighbour_projection(near.limit(0)).count() == 0
