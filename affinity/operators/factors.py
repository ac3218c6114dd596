"""Vectors of walk tokens by factorising what skip-gram with negative sampling fits.

Skip-gram with k negatives drawn from a smoothed distribution has its optimum
where the product of two tokens' vectors is ``log(n(a, b) / (n(a) P(b))) - log k``.
That matrix is built as a sparse table from co-occurrence counts, its positive part
kept, and factorised by block power iteration: each round multiplies the table
with a block of vectors by a join and a vector sum that is combined before its
shuffle, and makes the block orthonormal by its Gram matrix (``size`` squared
numbers, all that the driver sees). Rows of a hub are many partial sums, no list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.operators.order import drawn
from affinity.operators.session import written

DIMENSIONS, WINDOW, NEGATIVES, SMOOTHING, ROUNDS = 128, 5, 5, 0.75, 5


def cooccurrences(corpus: DataFrame, window: int = WINDOW) -> DataFrame:
    """How often tokens stand within a window of each other, nearer ones for more: a, b, n, both ways.

    A distance counts ``(window + 1 - distance) / window``, the chance that a window of
    random width reaches it.
    """
    spots = corpus.select("tokens", F.posexplode("tokens").alias("i", "a")).select("tokens", "i", "a", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("far"))
    pairs = spots.select("a", F.get("tokens", F.col("i") + F.col("far")).alias("b"), F.lit(window) + 1 - F.col("far")).toDF("a", "b", "n").where("b IS NOT NULL")
    both = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("a", "b").agg((F.sum("n") / window).alias("n"))


def shifted_pmi(counts: DataFrame, negatives: int = NEGATIVES, smoothing: float = SMOOTHING) -> DataFrame:
    """The positive part of each pair's log ratio to the negatives' chance: a, b, value."""
    sizes = written(counts.groupBy("a").agg(F.sum("n").alias("size")))
    total = sizes.agg(F.sum(F.pow("size", F.lit(smoothing))).alias("t")).scalar()
    b = sizes.select(F.col("a").alias("b"), (F.pow("size", F.lit(smoothing)) / total).alias("p"))
    value = F.log(F.col("n") / (F.col("size") * F.col("p"))) - math.log(negatives)
    return counts.join(sizes, "a").join(b, "b").select("a", "b", value.alias("value")).where("value > 0")


def times(table: DataFrame, block: DataFrame) -> DataFrame:
    """A sparse table (a, b, value) times a block of vectors (b, v): a, v."""
    return table.join(block, "b").groupBy("a").agg(Summarizer.sum(F.col("v"), F.col("value")).alias("v"))


def gram(block: DataFrame, other: DataFrame | None = None) -> np.ndarray:
    """The inner products of the columns of a block of vectors (b, v), with themselves or with those of another block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v, w = _matrix(batch.column(0)), _matrix(batch.column(1))
                total = v.T @ w + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    both = block.withColumn("w", F.col("v")) if other is None else block.join(other.withColumnRenamed("v", "w"), "b")
    parts = both.select(vector_to_array("v").alias("v"), vector_to_array("w").alias("w")).mapInArrow(run, "i int, row array<double>")
    summed = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    return np.array([r["row"] for r in summed.orderBy("i").collect()])  # size * size numbers


def turned(block: DataFrame, by: np.ndarray, key: str) -> DataFrame:
    """Each vector of a block times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1)) @ by
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(v), pa.list_(pa.float64()))], ["key", "v"])

    kind = block.schema[key].dataType.simpleString()
    return block.select(key, vector_to_array("v").alias("v")).mapInArrow(run, f"key {kind}, v array<double>").select(F.col("key").alias(key), array_to_vector("v").alias("v"))


def whitening(products: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray]:
    """The matrix that makes a block with these products orthogonal, with lengths to a power of its singular values (-0.5: one), and those."""
    values, axes = np.linalg.eigh(products)
    order = np.argsort(-values)
    values, axes = values[order], axes[:, order]
    good = values > max(values[0], 0) * 1e-14 if len(values) else np.zeros(0, bool)
    # Signs are free: each axis' largest part is positive, so runs agree.
    axes = axes[:, good]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(0)[None, :], 0) < 0, -1.0, 1.0)
    return axes * values[good] ** power, np.sqrt(values[good])


def power_iteration(table: DataFrame, back: DataFrame, size: int, rounds: int, seed: int) -> DataFrame:
    """An orthonormal block (b, v) that spans the leading right singular vectors of a table; ``back`` is its transpose."""
    more = size + 8  # a few spare columns make the last ones settle
    start = table.select("b").distinct().select("b", array_to_vector(F.transform(F.sequence(F.lit(1), F.lit(more)), lambda k: drawn(F.col("b"), k, F.lit(seed)) / float(1 << 32) - 0.5)).alias("v"))
    block = written(start)
    for _ in range(rounds):
        left = written(times(table, block))
        left = turned(left, whitening(gram(left), -0.5)[0], "a")
        block = written(times(back, left.withColumnRenamed("a", "b")).withColumnRenamed("a", "b"))
        block = written(turned(block, whitening(gram(block), -0.5)[0], "b"))
    return block


def factors(table: DataFrame, size: int = DIMENSIONS, rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """The left factor of a sparse table (a, b, value >= 0), columns scaled by the roots of the singular values: token, vector."""
    table = written(table)
    back = written(table.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    if table.isEmpty():
        return table.select(F.col("a").alias("token"), F.array(F.col("value")).alias("vector"))
    last = written(times(table, power_iteration(table, back, size, rounds, seed)))
    axes, values = whitening(gram(last), 0.0)
    return turned(last, (axes / np.sqrt(values))[:, :size], "a").select(F.col("a").alias("token"), vector_to_array("v").alias("vector"))


def neighbour_projection(near: DataFrame, size: int = 2, rounds: int = 20, seed: int = 42) -> DataFrame:
    """Coordinates that keep neighbours near: the slowest waves over the graph of neighbours (Laplacian eigenmaps): id, at.

    ``near`` has (id, other); links count both ways. Parts of the graph without a link
    between them lie on points of their own in some coordinates.
    """
    links = near.select(F.col("id").alias("a"), F.col("other").alias("b")).where("a <> b")
    links = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degree = written(links.groupBy("a").agg(F.sqrt(F.count("*").cast("double")).alias("root")))
    scaled = links.join(degree, "a").join(degree.withColumnsRenamed({"a": "b", "root": "other_root"}), "b").select("a", "b", (0.5 / (F.col("root") * F.col("other_root"))).alias("value"))
    # Half a loop on each node makes all eigenvalues positive, so that the largest are the slowest waves.
    table = written(scaled.unionByName(degree.select("a", F.col("a").alias("b"), F.lit(0.5).alias("value"))))
    if table.isEmpty():
        return table.select(F.col("a").alias("id"), F.array(F.col("value")).alias("at"))
    block = written(power_iteration(table, table, size + 1, rounds, seed))
    products = gram(block, times(table, block).withColumnRenamed("a", "b"))
    values, axes = np.linalg.eigh((products + products.T) / 2)
    waves = axes[:, np.argsort(-values)[1 : size + 1]]  # the first one is the degrees' root
    at = turned(block, waves, "b").withColumnRenamed("b", "a").join(degree, "a")
    return at.select(F.col("a").alias("id"), F.transform(vector_to_array("v"), lambda x: x / F.col("root")).alias("at"))


def token_vectors(corpus: DataFrame, size: int = DIMENSIONS, window: int = WINDOW, negatives: int = NEGATIVES) -> DataFrame:
    """Vectors of walk tokens, as skip-gram with negative sampling fits them: token, vector."""
    return factors(shifted_pmi(written(cooccurrences(corpus, window)), negatives), size)


def _matrix(column: pa.Array | Column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)
