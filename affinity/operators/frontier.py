"""Recommendation: frontiers of what lies next to a library, nearest neighbours, tag buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinity.functions import text, vectors
from affinity.operators import neighbour_index

# Responses that say that an artist is loved.
LOVED = ["seed_artist", "highlight", "loved", "anchor", "currently_listening"]
LOVED_FACTOR = 1.5
SCORE_PLACES = 9
#: Vectors that are compared as one block, those on a side of a cell, and cells for each core.
BLOCK, SIDE, CELLS_A_CORE = 2048, 1 << 17, 3
PLACES = 12


def discovery_frontier(directed: DataFrame, library: DataFrame, loved: DataFrame, most: int = 20, vias: int = 4) -> DataFrame:
    """Targets outside the library by summed match, more for loved sources: node, score, via.

    ``directed`` has (src, dst, match), ``library`` and ``loved`` (node).
    """
    own = directed.join(library.select(F.col("node").alias("src")), "src", "left_semi").join(library.select(F.col("node").alias("dst")), "dst", "left_anti")
    own = own.join(loved.select(F.col("node").alias("src"), F.lit(LOVED_FACTOR).alias("factor")).distinct(), "src", "left")
    score = F.round(F.sum(F.col("match") * F.coalesce("factor", F.lit(1.0))), SCORE_PLACES)  # the order of the sum doesn't show
    found = own.groupBy(F.col("dst").alias("node")).agg(score.alias("score"), F.array_sort(F.collect_set("src")).alias("via"))
    return found.withColumn("via", F.slice("via", 1, vias)).orderBy(F.desc("score"), "node").limit(most)


def nearest(points: DataFrame, id: str, vector: str, k: int = 8, queries: DataFrame | None = None) -> DataFrame:
    """The k nearest others of each point by cosine: id, other, cosine, rank; equals (to 12 places) by id.

    Exact. Vectors are measured once and dealt to a grid by a hash of their id:
    queries (all points unless given) to its rows, points to its columns. A cell
    compares its queries with its points, block by block, and keeps k for each query.
    What is shuffled is each query once a column and each point once a row, floats as
    floats; there are as many rows and columns as all cores take, whatever the number of
    shuffle partitions, and only past that as cells of ``SIDE`` vectors a side take.
    """
    spark, n = points.sparkSession, points.count()
    own = F.col(vector) if points.schema[vector].dataType == T.ArrayType(T.FloatType(), points.schema[vector].dataType.containsNull) else F.col(vector).cast("array<double>")
    unit = points.select(F.col(id).cast("long").alias("id"), own.alias("v"), (vectors.norm(F.col(vector)) + vectors.EPSILON).alias("length"))
    asked = unit if queries is None else unit.join(queries.select(F.col(id).cast("long").alias("id")), "id", "left_semi")
    q = n if queries is None else asked.count()
    rows, columns = grid(q, n, CELLS_A_CORE * max(8, spark.sparkContext.defaultParallelism))
    at = lambda salt, parts: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = asked.select("id", "v", "length", F.lit(True).alias("asks"), at("row", rows).alias("row"), every(columns).alias("column"))
    right = unit.select("id", "v", "length", F.lit(False).alias("asks"), every(rows).alias("row"), at("column", columns).alias("column"))
    dealt = left.unionByName(right).select((F.col("row") * columns + F.col("column")).alias("cell"), "asks", "id", "v", "length").repartition(rows * columns, "cell")
    found = dealt.groupBy("cell").applyInArrow(_cell_nearest(k), "id long, other long, cosine double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "other", "cosine", "rank")


def grid(queries: int, points: int, tasks: int) -> tuple[int, int]:
    """Rows and columns of a grid of cells: of at most about ``SIDE`` vectors a side, and enough of them for all tasks while a side has a block."""
    parts = lambda n, size: max(1, -(-n // size))
    rows, columns = parts(queries, SIDE), parts(points, SIDE)
    while rows * columns < tasks and (rows < parts(queries, BLOCK) or columns < parts(points, BLOCK)):
        # One more column costs each query once more, one more row each point.
        wider = queries < points if queries != points else columns <= rows
        if columns >= parts(points, BLOCK) or (not wider and rows < parts(queries, BLOCK)):
            rows += 1
        else:
            columns += 1
    return rows, columns


def _cell_nearest(k: int):
    """For each query of a cell the k nearest of its points."""

    def matrix(table: pa.Table, asks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = table.filter(pc.equal(table["asks"], asks)).sort_by("id").combine_chunks()
        ids = own["id"].to_numpy()
        return ids, own["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.zeros((0, 1)), own["length"].to_numpy()

    def unit(v: np.ndarray, length: np.ndarray, start: int) -> np.ndarray:
        return v[start : start + BLOCK].astype(np.float64) / length[start : start + BLOCK, None]

    def best_of(ids: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, lengths: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, ...]:
        row, other, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        worst = np.full(len(ids), -np.inf)  # the last of k found; later points equal to it have larger ids
        for start in range(0, len(others), BLOCK):
            near = others[start : start + BLOCK]
            cosine = np.matmul(a, unit(b, lengths, start).T, out=space[: len(ids) * len(near)].reshape(len(ids), len(near)))
            last = np.searchsorted(near, ids, "right")  # both ascend; an id may be repeated
            equal = last - np.searchsorted(near, ids)
            cosine[np.repeat(np.arange(len(ids)), equal), np.arange(equal.sum()) - np.repeat(np.cumsum(equal) - last, equal)] = -np.inf
            least = worst
            if len(near) > k and np.isneginf(worst).any():
                least = np.maximum(worst, np.partition(cosine, len(near) - k, axis=1)[:, len(near) - k])
            r, c = np.divmod(np.flatnonzero(cosine > (least - 2 * 10.0**-PLACES)[:, None]), len(near))
            found = np.round(cosine[r, c], PLACES)
            good = np.isfinite(found) & (found > worst[r])
            row, other, value = np.concatenate([row, r[good]]), np.concatenate([other, near[c[good]]]), np.concatenate([value, found[good]])
            order = np.lexsort((other, -value, row))
            row, other, value = row[order], other[order], value[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, other, value, place = (x[place < k] for x in (row, other, value, place))
            worst[row[place == k - 1]] = value[place == k - 1]
        return row, other, value

    def run(table: pa.Table) -> pa.Table:
        (ids, a, own_lengths), (others, b, lengths) = matrix(table, True), matrix(table, False)
        out, space = [], np.empty(min(BLOCK, len(ids)) * min(BLOCK, len(others)))  # taken once: the cosines of two blocks
        for start in range(0, len(ids) if len(others) else 0, BLOCK):
            own = ids[start : start + BLOCK]
            row, other, value = best_of(own, unit(a, own_lengths, start), others, b, lengths, space)
            out.append(pa.table({"id": own[row], "other": other, "cosine": value}))
        none = pa.table({"id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "cosine": np.zeros(0)})
        return pa.concat_tables([none, *out])

    return run


def geometric_frontier(neighbours: DataFrame, library: DataFrame, most: int = 20) -> DataFrame:
    """Neighbours outside the library by how many of the library have them near: node, sources, via."""
    own = neighbours.join(library.select(F.col("node").alias("id")), "id", "left_semi").join(library.select(F.col("node").alias("other")), "other", "left_anti")
    found = own.groupBy(F.col("other").alias("node")).agg(F.count_distinct("id").alias("sources"), F.array_sort(F.collect_set("id")).alias("via"))
    return found.orderBy(F.desc("sources"), "node").limit(most)


def mutual_ranks(neighbours: DataFrame, named: DataFrame) -> DataFrame:
    """For each ordered pair of named points the rank of the second among the first's neighbours, or null: id, other, rank."""
    a, b = named.select(F.col("node").alias("id")).distinct(), named.select(F.col("node").alias("other")).distinct()
    pairs = a.join(F.broadcast(b), F.col("id") != F.col("other"))  # the caller's short list of names
    return pairs.join(neighbours.select("id", "other", "rank"), ["id", "other"], "left")


def tag_buckets(tagged: DataFrame, tags: str, most: int = 14) -> DataFrame:
    """Adds ``primary_tag`` and ``bucket``: the tag if it is among the most frequent, else ``other``."""
    own = tagged.withColumn("primary_tag", text.primary_tag(F.col(tags)))
    top = own.groupBy("primary_tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "primary_tag").limit(most)
    top = top.select("primary_tag", F.col("primary_tag").alias("bucket"))
    return own.join(F.broadcast(top), "primary_tag", "left").withColumn("bucket", F.coalesce("bucket", F.lit("other")))  # ``most`` rows


def bridges(nodes: DataFrame, most: int = 15, by: str = "betweenness") -> DataFrame:
    """The artists of most betweenness."""
    return nodes.where("kind = 'artist'").orderBy(F.desc(by), "node").limit(most)


def loved(nodes: DataFrame, response: str = "will_response") -> DataFrame:
    """The nodes whose response is exactly one of the loved ones."""
    return nodes.where(F.col(response).isin(LOVED))


def track_features(tracks: DataFrame, id: str, vocabulary: list[str], macros: list[str]) -> DataFrame:
    """A track's vector: descriptors one-hot, log seconds over the most, year scaled to the corpus, macro genres one-hot: id, vector.

    ``tracks`` has descriptors, macros (lists), played_seconds, release_year; a missing year counts as the least.
    """
    low, high = tracks.agg(F.min("release_year").alias("x")).scalar(), tracks.agg(F.max("release_year").alias("x")).scalar()
    top = tracks.agg(F.max(F.log1p(F.col("played_seconds").cast("double"))).alias("x")).scalar()
    flags = lambda column, names: [F.array_contains(column, x).cast("double") for x in names]
    year = (F.coalesce(F.col("release_year"), low) - low) / F.greatest(high - low, F.lit(1))
    seconds = F.log1p(F.col("played_seconds").cast("double")) / F.when(top > 0, top).otherwise(1.0)
    return tracks.select(F.col(id), F.array(*flags("descriptors", vocabulary), F.coalesce(seconds, F.lit(0.0)), F.coalesce(year.cast("double"), F.lit(0.0)), *flags("macros", macros)).alias("vector"))


def more_like(tracks: DataFrame, id: str, vocabulary: list[str], macros: list[str], k: int = 10, asked: DataFrame | None = None) -> DataFrame:
    """The k tracks most like each (or each asked for): id, other, cosine, rank; equals (to 12 places) by id.

    Exact. Tracks of the same descriptors, macros and year lie on one line by their seconds,
    so the cells of an index are short and few need a look. Vectors without length
    have a cosine of 0 with all others; of them only the first ones by id can count.
    """
    points = track_features(tracks, id, vocabulary, macros).select(F.col(id).cast("long").alias("id"), "vector")
    wanted = points.select("id") if asked is None else asked.select(F.col(id).cast("long").alias("id"))
    found = neighbour_index.CellIndex(points, "id", "vector").nearest(wanted, "id", k, first=1)
    length = vectors.norm(F.col("vector"))
    none = points.where(length == 0).select("id")
    if none.isEmpty():
        return found
    least = lambda rows: F.broadcast(rows.select(F.col("id").alias("other")).orderBy("other").limit(k + 1))  # noqa: E731  k + 1 rows
    asks = points.where(length > 0).join(wanted, "id", "left_semi").select("id").crossJoin(least(none))
    lone = none.join(wanted, "id", "left_semi").crossJoin(least(points.where(length >= 0)))
    zeros = asks.unionByName(lone).where("id <> other").withColumn("cosine", F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    both = found.select("id", "other", "cosine").unionByName(zeros)
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "other", "cosine", "rank")


def blend(known: DataFrame, new: DataFrame, most: int, known_share: float = 0.6, excluded: list[str] | None = None) -> DataFrame:
    """A list of known and new items in given shares; both have (node, score, response)."""
    drop = excluded if excluded is not None else ["single-listen", "did_not_land"]
    keep = lambda d, n, k: d.where(F.col("response").isNull() | ~F.col("response").isin(drop)).orderBy(F.desc("score"), "node").limit(n).withColumn("kind", F.lit(k))
    n = round(most * known_share)
    return keep(known, n, "known").unionByName(keep(new, most - n, "new"))
