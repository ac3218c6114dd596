"""Near-duplicate vectors by cosine: a small-world graph in each shard, every shard asked by every vector.

1. Equal vectors are one class (by 128 bits of hash); only classes go on, so any
   number of copies is one row.
2. Classes are dealt into shards by their number; a shard's vectors become balls
   and a graph over their centres (see ``hnsw``), written as a table of bytes.
3. Every class asks every shard. Shards and blocks of queries make the tasks: a
   task loads one shard and audits its beam against a comparison with all centres
   for a sample of its queries and centres, doubling it until none is missed.
   Finds are verified: balls that lie wholly within the limit are counted whole,
   vectors at the edge one by one in double precision.
4. A task gives sums of links and, instead of links, a star for each component of
   what it linked; their number is that of the vectors, not of the links.
5. Stars of all tasks are united over the cluster.

Work is that of each vector in each shard: shards grow to ``SHARD_ROWS`` before
there are more than ``LEAST_SHARDS``, so up to then it grows like n log n, and
beyond like n * n / SHARD_ROWS * log(SHARD_ROWS), as every shard is to be asked.

Vectors that are null, empty or zero, or hold null or non-finite components,
link with nothing. Vectors of different length don't link. Every row counts: rows
that repeat an id are vectors of their own. Rows without an id count as links of
others and have links, but aren't named: a component's id is the least id there
is in it, null if there is none, and they are never kept. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm import hnsw
from affinity.llm.common import hot_keys, materialize, met
from affinity.llm.components import components

LIMIT = 0.95
LEAST_SHARDS, SHARD_ROWS = 4, 100_000
LEAST_BLOCKS, BLOCK_ROWS = 2, 400_000
#: Beam with which audits begin.
BEAM = 32
PIECE_BYTES = 16 << 20
PAIRS_AT_ONCE = 1 << 18
KEYS = ["h1", "h2"]


def comparable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, all components finite, one not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def classes(rows: DataFrame) -> DataFrame:
    """The distinct vectors: cid, least (id), weight (rows), dim and embedding."""
    grouped = rows.groupBy(*KEYS).agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    return materialize(grouped.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))


def _vectors(table: pa.Table, dim: int) -> np.ndarray:
    """A column of vectors, each scaled by a power of two to about one."""
    flat = table["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
    _, exponent = np.frexp(np.abs(flat).max(1, initial=0))
    return np.ldexp(flat, -exponent[:, None])


def build(table: pa.Table) -> pa.Table:
    """A shard's index, in pieces."""
    dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
    table = table.sort_by("cid")
    data = hnsw.Index(table["cid"].to_numpy(), table["weight"].to_numpy(), _vectors(table, dim)).dump()
    pieces = [data[a : a + PIECE_BYTES] for a in range(0, len(data), PIECE_BYTES)]
    n = len(pieces)
    return pa.table({"dim": pa.array([dim] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "piece": pa.array(range(n), pa.int32()), "data": pa.array(pieces, pa.binary())})


class Stars:
    """Connected components of numbered nodes, by hooking roots to smaller ones."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        """Unite the ends of edges."""
        while True:
            a, b = self.root[u], self.root[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def search(table: pa.Table, pieces: pa.Table, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """For a block of vectors and a shard: each one's links, the stars (id, centre's id), and the audited recall."""
    dim = table["dim"][0].as_py()
    ids, vectors = table["cid"].to_numpy(), _vectors(table, dim)
    index = hnsw.Index.load(b"".join(pieces.sort_by("piece")["data"].to_pylist()))
    unit, own_norms, most = hnsw.units(vectors), hnsw.norms(vectors), math.acos(limit)
    beam, recall = index.audit(ids, unit, most, BEAM)
    q, b = index.balls(unit, most, beam)
    home = index.home(ids)
    there = np.flatnonzero(home >= 0)
    count = len(index.radius)
    pairs = np.unique(np.concatenate([q * count + b, there * count + home[there]]))
    q, b = pairs // count, pairs % count
    links = np.zeros(len(ids), np.int64)
    # Members are nodes 0 to m - 1, queries of other shards come after them.
    m = len(index.ids)
    order = np.argsort(index.ids)
    place = order[np.minimum(np.searchsorted(index.ids, ids, sorter=order), m - 1)]
    node = np.where(index.ids[place] == ids, place, m + np.arange(len(ids)))
    stars = Stars(m + len(ids))
    whole = np.zeros(count, np.int64)
    keys = np.repeat(np.arange(count) * 10.0, np.diff(index.begin)) + index.angle
    for a in range(0, len(q), PAIRS_AT_ONCE):
        qa, ba = q[a : a + PAIRS_AT_ONCE], b[a : a + PAIRS_AT_ONCE]
        angle = np.arccos(np.clip(np.einsum("ij,ij->i", unit[qa], index.graph.vectors[ba]), -1, 1)).astype(np.float64)
        until = lambda value, side: np.searchsorted(keys, ba * 10.0 + np.clip(value, -1, 5), side)  # noqa: E731,B023
        begin = index.begin[ba]
        sure = until(most - angle - hnsw.SLACK, "right")  # all members up to here are linked
        low = np.maximum(sure, until(angle - most - hnsw.SLACK, "left"))
        high = np.maximum(low, until(angle + most + hnsw.SLACK, "right"))
        np.add.at(links, qa, index.weight[sure] - index.weight[begin])
        some = sure > begin
        stars.link(node[qa[some]], begin[some])
        np.maximum.at(whole, ba, sure - begin)
        verify(index, ids, vectors, own_norms, node, qa, low, high, limit, links, stars)
    inner = np.arange(m) - np.repeat(index.begin[:-1], np.diff(index.begin))
    full = np.flatnonzero((inner > 0) & (inner < np.repeat(whole, np.diff(index.begin))))
    stars.link(full, full - inner[full])
    names = np.concatenate([index.ids, ids])
    leaves = np.flatnonzero(stars.root != np.arange(len(names)))
    return ids, links, names[leaves], names[stars.root[leaves]], recall


def verify(index: hnsw.Index, ids: np.ndarray, vectors: np.ndarray, own_norms: np.ndarray, node: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, limit: float, links: np.ndarray, stars: Stars) -> None:
    """Compare queries with members low to high one by one in double precision; an own class counts whatever its rounding."""
    ends = np.cumsum(high - low)
    for a in range(0, int(ends[-1]), PAIRS_AT_ONCE):
        flat = np.arange(a, min(a + PAIRS_AT_ONCE, int(ends[-1])))
        row = np.searchsorted(ends, flat, "right")
        query, member = q[row], high[row] + flat - ends[row]
        cosine = np.einsum("ij,ij->i", vectors[query].astype(np.float64), index.vectors[member].astype(np.float64)) / (own_norms[query] * index.norms[member])
        good = (cosine >= limit) | (index.ids[member] == ids[query])
        np.add.at(links, query[good], index.weight[member[good] + 1] - index.weight[member[good]])
        stars.link(node[query[good]], member[good])


FOUND = "cid long, links long, other long, recall double"


def neighbours(known: DataFrame, limit: float = LIMIT) -> DataFrame:
    """What the tasks find of classes: (cid, links) sums, (cid, other) edges, and the recall of each task's audit."""
    sizes = known.groupBy("dim").agg(F.count("*").alias("n"))
    parts = lambda least, rows: F.greatest(F.lit(least), F.ceil(F.col("n") / rows)).cast("int")
    sizes = sizes.select("dim", parts(LEAST_SHARDS, SHARD_ROWS).alias("shards"), parts(LEAST_BLOCKS, BLOCK_ROWS).alias("blocks"))
    dealt = known.select("cid", "weight", "dim", "embedding").join(sizes, "dim")
    home = F.pmod(F.xxhash64("cid"), F.col("shards")).cast("int")
    n = known.count()
    # A stated number of partitions, as adaptive execution would put these small but slow groups into few tasks.
    tasks = max(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * LEAST_SHARDS * LEAST_BLOCKS, 2 * (n // SHARD_ROWS) * (n // BLOCK_ROWS))
    index = materialize(dealt.withColumn("shard", home).repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, piece int, data binary"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    copies = index.join(sizes, "dim").select("dim", "shard", "piece", "data", each("blocks").alias("block"))
    asked = dealt.withColumn("block", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("blocks")).cast("int")).select("cid", "dim", "embedding", "block", each("shards").alias("shard"))

    def run(queries: pa.Table, pieces: pa.Table) -> pa.Table:
        empty = pa.table({"cid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "recall": pa.array([], pa.float64())})
        if not len(queries) or not len(pieces):
            return empty
        ids, links, leaf, centre, recall = search(queries, pieces, limit)
        some = links > 0
        ids, links = ids[some], links[some]
        n, k = len(ids), len(leaf)
        sums = pa.table({"cid": ids, "links": links, "other": pa.nulls(n, pa.int64()), "recall": pa.nulls(n, pa.float64())})
        stars = pa.table({"cid": leaf, "links": pa.nulls(k, pa.int64()), "other": centre, "recall": pa.nulls(k, pa.float64())})
        audit = pa.table({"cid": pa.nulls(1, pa.int64()), "links": pa.nulls(1, pa.int64()), "other": pa.nulls(1, pa.int64()), "recall": pa.array([recall])})
        return pa.concat_tables([sums, stars, audit])

    keys = ["dim", "shard", "block"]
    asked, copies = asked.repartition(tasks, *keys), copies.repartition(tasks, *keys)
    return materialize(asked.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(run, FOUND))


def dedup(vectors: DataFrame, limit: float = LIMIT) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select("vec_id", "embedding")
    good = rows.where(comparable(F.col("embedding"))).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    known = classes(good)
    found = neighbours(known, limit)
    links = found.where("links IS NOT NULL").groupBy("cid").agg(F.sum("links").alias("links"))
    united = components(found.where("other IS NOT NULL"), "cid", "other").select(F.col("node").alias("cid"), "root")
    placed = known.select("cid", "least", "weight", *KEYS).join(united, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    judged = materialize(placed.join(least, "root").join(links, "cid").select(*KEYS, "weight", (F.col("links") - 1).alias("n_links"), "component_id"))
    compared = met(good.select("vec_id", *KEYS), judged.drop("weight"), hot_keys(judged, "weight"), KEYS, F.xxhash64("vec_id"))
    alone = rows.where(~comparable(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = compared.select("vec_id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def dedup_sql(limit: float = LIMIT) -> str:
    """DuckDB SQL for ``dedup`` by comparing all pairs (each id once)."""
    return f"""WITH RECURSIVE good AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {limit}),
reach(v, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, reach.r FROM reach JOIN pairs p ON p.a = reach.v AND reach.r < p.b),
least AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id) AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN least ON v = vec_id"""
