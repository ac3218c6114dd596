"""Nearest neighbours by an index of cells (inverted file), for some queries against all points.

Cell centres are fitted by k-means on a bounded sample; every point lies in the
cell of its nearest centre. A query looks into the cells nearest to it. How many
are needed for a wanted recall is measured: a bounded number of queries is
compared with all points, and the place of each true neighbour's cell in the
query's order of cells tells how many cells would have found it. Without a number
of cells the search is exact: a first look gives each query a bound, and a second
goes into the cells that may hold something better, by the angle to the centre
less the cell's widest angle.

What is sent to all workers is the centres, ``MOST_CELLS`` at most. Cells are cut
into blocks of about ``BLOCK`` points by hash, so a cell that holds a third of all
points is many tasks' work. Vectors that are null or without length aren't points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinity.functions import vectors
from affinity.operators.order import drawn
from affinity.operators.session import written

#: Points from which the centres are fitted, rounds of k-means, centres, points in a block, queries of the recall measure.
SAMPLE, ROUNDS, MOST_CELLS, BLOCK, ASKED = 20_000, 8, 2048, 4096, 256
PLACES = 12
#: Slack of the angle bounds against rounding.
SLACK = 1e-6
NEAR = "id long, other long, cosine double"


def lowest(rows: DataFrame, id: str, most: int, salt: str) -> DataFrame:
    """At most so many rows of least hash of their id; the limit is taken in each task first."""
    return rows.orderBy(drawn(F.col(id), F.lit(salt)), id).limit(most)


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres by spherical k-means from the first ``cells`` of the sample; empty cells keep their centre."""
    centres = sample[:cells].copy()
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


class CellIndex:
    """Points by cell: ``rows`` (cell, part, id, v), written once; ``centres``; the widest angle of each cell."""

    def __init__(self, points: DataFrame, id: str, vector: str, cells: int | None = None):
        length = vectors.norm(F.col(vector))
        unit = points.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), length.alias("length")).where("length > 0")
        tasks = unit.sparkSession.sparkContext.defaultParallelism
        if unit.rdd.getNumPartitions() < tasks:  # few files are read by few tasks
            unit = unit.repartition(3 * tasks)
        n = unit.count()
        sample = lowest(unit, "id", SAMPLE, "cells").collect()  # a bounded sample
        wanted = min(cells or math.isqrt(n), MOST_CELLS, len(sample))
        self.centres = fitted(np.array([r["v"] for r in sample]) / (np.array([r["length"] for r in sample]) + vectors.EPSILON)[:, None], wanted) if wanted else np.zeros((0, 1))
        self.points = n
        placed = written(self._placed(unit))
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("widest"))  # a row for each centre
        known = {r["cell"]: (r["n"], r["widest"]) for r in sizes.collect()}
        self.sizes = np.array([known.get(c, (0, 0))[0] for c in range(wanted)], np.int64)
        self.parts = [max(1, -(-known.get(c, (0, 0))[0] // BLOCK)) for c in range(wanted)]
        self.widest = np.array([known.get(c, (0, -4.0))[1] for c in range(wanted)])
        parts = F.element_at(F.array(*map(F.lit, self.parts)), F.col("cell") + 1) if wanted else F.lit(1)
        self.rows = placed.select("cell", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "id", "v")

    def _placed(self, unit: DataFrame) -> DataFrame:
        """Each point as a unit vector, its nearest centre and the angle to it."""
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                v = _matrix(batch.column(1)) / (batch.column(2).to_numpy() + vectors.EPSILON)[:, None]
                cosine = v @ centres.T
                cell = cosine.argmax(1)
                angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1, 1))
                ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, v.ravel()), pa.array(cell.astype(np.int32)), pa.array(angle)], ["id", "v", "cell", "angle"])

        return unit.mapInArrow(run, "id long, v array<double>, cell int, angle double")

    def queries(self, ids: DataFrame, id: str) -> DataFrame:
        """The indexed points that are asked for: id, v."""
        return self.rows.join(ids.select(F.col(id).cast("long").alias("id")).distinct(), "id", "left_semi").select("id", "v")

    def looked_up(self, asked: DataFrame, choose) -> DataFrame:
        """Each query with the cells that ``choose(queries, extra)`` (rows, cells) names, one row for each block of theirs: cell, part, id, v."""
        parts, extra = np.array(self.parts), [c for c in asked.columns if c not in ("id", "v")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                v = _matrix(batch.column(1))
                row, cell = choose(v, [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in extra])
                n = parts[cell]
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                for a in range(0, len(row), BLOCK):
                    few = pa.array(row[a : a + BLOCK])
                    columns = [pa.array(x[a : a + BLOCK].astype(np.int32)) for x in (cell, part)]
                    yield pa.RecordBatch.from_arrays([*columns, batch.column(0).take(few), batch.column(1).take(few)], ["cell", "part", "id", "v"])

        return asked.select("id", "v", *extra).mapInArrow(run, "cell int, part int, id long, v array<double>")

    def compared(self, asked: DataFrame, k: int) -> DataFrame:
        """For each block of points that queries look into, the k nearest for each: id, other, cosine."""

        def run(queries: pa.Table, points: pa.Table) -> pa.Table:
            points = points.sort_by("id")
            ids, others = queries["id"].to_numpy(), points["id"].to_numpy()
            out = []
            if len(others):
                base = _matrix(points["v"].combine_chunks())
                wide = max(1, (1 << 22) // len(others))
                for a in range(0, len(ids), wide):
                    own = ids[a : a + wide]
                    cosine = np.round(_matrix(queries["v"].slice(a, wide).combine_chunks()) @ base.T, PLACES)
                    cosine[own[:, None] == others[None, :]] = -np.inf
                    row, column, value = best(cosine, k)
                    out.append((own[row], others[column], value))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            return pa.table(dict(zip(("id", "other", "cosine"), columns, strict=True)))

        keys = ["cell", "part"]
        return asked.groupBy(*keys).cogroup(self.rows.groupBy(*keys)).applyInArrow(run, NEAR)

    def nearest(self, ids: DataFrame, id: str, k: int = 8, probes: int | None = None, first: int | None = None) -> DataFrame:
        """The k nearest others of each query by cosine: id, other, cosine, rank; equals (to 12 places) by id.

        ``probes`` cells are looked into, or as many as it takes to be exact; of these
        ``first`` (a 16th of all unless given) for a bound, and more by a query whose first ones hold too few points.
        """
        if not len(self.centres):
            return self.rows.sparkSession.createDataFrame([], "id long, other long, cosine double, rank int")
        asked = self.queries(ids, id)
        centres, widest = self.centres, self.widest
        first, sizes = probes or min(first or max(1, len(centres) // 16), len(centres)), self.sizes

        def look(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            row, cell = _nearest_cells(v, centres, first)
            if probes is not None:
                return row, cell
            short = np.flatnonzero(sizes[cell].reshape(len(v), -1).sum(1) <= k)
            more, wider = _nearest_cells(v[short], centres, min(len(centres), first * 16))
            kept = ~np.isin(row, short)
            return np.append(row[kept], short[more]), np.append(cell[kept], wider)

        found = self.compared(self.looked_up(asked, lambda v, _: look(v)), k)
        if probes is None:
            found = written(found)
            bound = _ranked(found, k).where(F.col("rank") == k).select("id", "cosine")
            again = asked.join(bound, "id", "left").withColumn("cosine", F.coalesce("cosine", F.lit(-1.0)))

            def rest(v: np.ndarray, extra: list) -> tuple[np.ndarray, np.ndarray]:
                cosine = v @ centres.T
                reach = np.cos(np.clip(np.arccos(np.clip(cosine, -1, 1)) - widest[None, :] - SLACK, 0, math.pi))
                wanted = (reach >= extra[0][:, None]) & (widest >= 0)[None, :]
                wanted[look(v)] = False
                return np.nonzero(wanted)

            found = found.unionByName(self.compared(self.looked_up(again, rest), k))
        return _ranked(found, k)

    def probes_for(self, recall: float = 0.9, k: int = 8, asked: int = ASKED) -> tuple[int, float]:
        """The least number of cells that finds the wanted share of true neighbours, and the share it finds.

        Measured on ``asked`` points of least hash, each compared with all points.
        """
        if not len(self.centres):
            return 1, 1.0
        own = written(lowest(self.rows.select("id", "v"), "id", asked, "recall"))
        every = np.arange(len(self.centres))
        whole = self.compared(self.looked_up(own, lambda v, _: (np.repeat(np.arange(len(v)), len(every)), np.tile(every, len(v)))), k)
        true = _ranked(whole, k).join(self.rows.select(F.col("id").alias("other"), "cell"), "other").join(own, "id").select("cell", "v")
        centres = self.centres

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cosine = _matrix(batch.column(1)) @ centres.T
                cell = batch.column(0).to_numpy()
                mine = cosine[np.arange(len(cell)), cell]
                ahead = (cosine > mine[:, None]).sum(1) + ((cosine == mine[:, None]) & (every[None, :] < cell[:, None])).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(ahead.astype(np.int32))], ["ahead"])

        counts = {r["ahead"]: r["n"] for r in true.mapInArrow(place, "ahead int").groupBy("ahead").agg(F.count("*").alias("n")).collect()}  # a row for each centre at most
        total, seen = sum(counts.values()), 0
        for ahead in sorted(counts):
            seen += counts[ahead]
            if seen >= recall * total:
                return ahead + 1, seen / total
        return 1, 1.0


def best(cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the k largest of each row, of equals those of least column; -inf never counts."""
    most = min(k, cosine.shape[1])
    least = -np.partition(-cosine, most - 1, axis=1)[:, most - 1]
    row, column = np.nonzero(cosine >= least[:, None])  # ties at the bound stay until they are ranked
    value = cosine[row, column]
    order = np.lexsort((column, -value, row))
    row, column, value = row[order], column[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    good = (place < most) & np.isfinite(value)
    return row[good], column[good], value[good]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most that their cosines with all centres are a few MB."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            yield batch.slice(start, 1024)


def _nearest_cells(v: np.ndarray, centres: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells nearest to each query, of equals the first ones."""
    cosine = v @ centres.T
    order = cosine.argmax(1)[:, None] if probes == 1 else np.argsort(-cosine, axis=1, kind="stable")[:, :probes]
    return np.repeat(np.arange(len(v)), order.shape[1]), order.ravel()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank: Column = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
