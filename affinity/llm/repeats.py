"""Repeated windows across a corpus: where they start earlier, and what is left without them.

Shared by the two substring operators, which differ in symbols (words, bytes)
and in the index that resolves what segments of one anchor have in common.

1. Every text is cut into anchored segments (see ``anchors``). Anchors that
   occur once can't lie in a repeat; the others' segments go on.
2. Equal segments are one class, with its first occurrence.
3. The classes' texts (one for each class) are dealt into shards by anchor, and
   each shard's index finds for every window of a class its first occurrence.
   An anchor of more than ``MANY_CLASSES`` classes doesn't fit one shard; its
   windows are aggregated one by one over the cluster instead, as exactly.
4. Every occurrence of a segment compares itself with these; what starts
   earlier elsewhere is removed from its document.

Anchors and classes with over a thousandth of all segments (fewer than a
thousand each) are joined by broadcast, all others by shuffle. Texts are
shuffled by document, the same way at every size.

Rows without an id keep all of their text and aren't compared. Rows that repeat
an id are one document for the order of occurrences ("earlier" is the smaller id,
then the earlier start in any of its rows), but each row loses what its own text
repeats; different texts of one id are told apart by 64 bits of a hash. Texts of
any length are cut in overlapping parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm import anchors, signatures
from affinity.llm.common import hot_keys, let, materialize, met, running, text_slices

#: ``place`` packs start (31 bits), n (7) and offset (7).
BITS = 7
SEGMENT = "doc_id long, body long, anchor long, content long, place long, times int"
CLASS = "anchor long, content long, lo int, hi int, doc long, at int"
#: Classes of an anchor from which its windows are aggregated one by one.
MANY_CLASSES = 4000
#: Bytes of classes in a shard.
SHARD_BYTES = 4 << 20


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def body() -> Column:
    """What tells texts of one id apart: a hash of 64 bits."""
    return F.xxhash64("text")


def segments(docs: DataFrame, kind: type) -> DataFrame:
    """The anchored segments of all documents with an id; equal ones that follow one another are one row of several ``times``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = kind()
        for batch in batches:
            for part in text_slices(batch, 1 << 20):
                row, begin, parts = _cut(part, symbols)
                # Parts of a long text one by one, so that memory is bounded.
                for few in _runs([len(x) for x in parts], 1 << 20):
                    found = anchors.Segments([parts[k] for k in few], symbols)
                    if len(found.text):
                        where = np.array([row[k] for k in few])[found.text]
                        start = found.start + np.array([begin[k] for k in few])[found.text]
                        place = (start << BITS | found.n) << BITS | found.offset
                        rows = pa.array(where)
                        yield pa.RecordBatch.from_arrays(
                            [_column(part, "doc_id").take(rows), _column(part, "body").take(rows), pa.array(found.anchor.view(np.int64)), pa.array(found.content.view(np.int64)), pa.array(place), pa.array(found.times.astype(np.int32))],
                            ["doc_id", "body", "anchor", "content", "place", "times"],
                        )

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", body().alias("body")).mapInArrow(run, SEGMENT)


def anchor_counts(docs: DataFrame, kind: type) -> DataFrame:
    """The anchors of the segments of all documents with an id, and how many segments in each run of texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = kind()
        for batch in batches:
            for part in text_slices(batch, 1 << 20):
                parts = _cut(part, symbols)[2]
                for few in _runs([len(x) for x in parts], 1 << 20):
                    found, times = np.unique(anchors.Segments([parts[k] for k in few], symbols, False).anchor, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], ["anchor", "times"])

    return docs.where("doc_id IS NOT NULL").select("text").mapInArrow(run, "anchor long, times long")


def _cut(part: pa.RecordBatch, symbols) -> tuple[list[int], list[int], list[np.ndarray]]:
    """The symbols of a batch's texts, long ones in parts: the row, the place and the symbols of each."""
    row, begin, parts = [], [], []
    for k, text in enumerate(_column(part, "text").to_pylist()):
        for at, own in anchors.cut(symbols.read(text), symbols.k):
            row.append(k)
            begin.append(at)
            parts.append(own)
    return row, begin, parts


def _runs(sizes: list[int], most: int) -> Iterator[range]:
    """Neighbours of at most so much in all, or one of more."""
    first = total = 0
    for k, n in enumerate(sizes):
        if k > first and total + n > most:
            yield range(first, k)
            first, total = k, 0
        total += n
    if sizes:
        yield range(first, len(sizes))


def unpacked(place: Column) -> list[Column]:
    """start, n and offset of packed places."""
    low = lambda c, bits: c.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    shift = lambda bits: F.shiftright(place, bits)
    return [
        shift(2 * BITS).cast("int").alias("start"), low(shift(BITS), BITS).alias("n"), low(place, BITS).alias("offset"),
    ]


def class_texts(docs: DataFrame, classes: DataFrame, kind: type) -> DataFrame:
    """The symbols of each class, from its first occurrence: the class's columns and ``symbols`` (binary)."""
    first = classes.select("anchor", "content", "k", F.col("first.doc_id").alias("doc"), F.col("first.body").alias("body"), *unpacked(F.col("first.place")))
    own = F.collect_list(F.struct("anchor", "content", "k", "start", "n", "offset")).alias("own")
    wanted = first.groupBy("doc", "body").agg(own)
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), body().alias("body"), "text").join(wanted.hint("merge"), ["doc", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = kind()
        for batch in batches:
            for part in text_slices(batch):
                own = _column(part, "own")
                anchor, content, k, start, n, offset = [x.to_numpy() for x in own.flatten().flatten()]
                read = [symbols.read(text) for text in _column(part, "text").to_pylist()]
                sizes = np.array([len(x) for x in read], np.int64)
                begin, every = np.cumsum(sizes) - sizes, np.concatenate(read)
                row = np.repeat(np.arange(len(read)), pc.list_value_length(own).to_numpy())
                length = n.astype(np.int64) + symbols.k - 1
                there = np.flatnonzero(start + length <= sizes[row])  # else another text of the same id and hash
                # Long texts have many classes: so many symbols at a time.
                ends = np.cumsum(length[there])
                a = 0
                while a < len(there):
                    b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 22), "right")))
                    few = there[a:b]
                    a = b
                    until = np.cumsum(length[few])
                    spots = np.arange(until[-1]) + np.repeat((begin[row] + start)[few] - until + length[few], length[few])
                    bounds = np.append(0, until * every.itemsize).astype(np.int32)
                    taken = pa.Array.from_buffers(pa.binary(), len(few), [None, pa.py_buffer(bounds), pa.py_buffer(every[spots])])
                    longs = [pa.array(x[few]) for x in (anchor, content, k)]
                    ints = [pa.array(x[few].astype(np.int32)) for x in (n, offset, start + offset)]
                    yield pa.RecordBatch.from_arrays([_column(part, "doc").take(pa.array(row[few])), *longs, *ints, taken], names)

    names = ["doc", "anchor", "content", "k", "n", "offset", "at", "symbols"]
    schema = "doc long, anchor long, content long, k long, n int, offset int, at int, symbols binary"
    return rows.select("doc", "text", "own").mapInArrow(run, schema)


def once(table: pa.Table) -> pa.Table:
    """The classes of a shard, each once: rows that repeat an id and its text bring theirs again."""
    anchor, content = (table[x].to_numpy() for x in ("anchor", "content"))
    order = np.lexsort((content, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(anchor[order]) != 0) | (np.diff(content[order]) != 0)
    return table if new.all() else table.take(pa.array(np.sort(order[new])))


def one_by_one(texts: DataFrame, kind: type) -> DataFrame:
    """First occurrences of the windows of classes, each window aggregated by its hash (128 bits with the anchor's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = kind()
        for batch in batches:
            for row in batch.to_pylist():
                read = np.frombuffer(row["symbols"], symbols.read("").dtype)
                values = np.lib.stride_tricks.sliding_window_view(symbols.values(read), symbols.k)
                hashes = np.zeros(len(values), np.uint64)
                for i in range(symbols.k):
                    hashes = signatures.mix(hashes + values[:, i])
                n = row["n"]
                place = row["offset"] - np.arange(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[x]] * n, pa.int64()) for x in ("anchor", "content", "doc")] + [pa.array([row["at"]] * n, pa.int32()), pa.array(place.astype(np.int32)), pa.array(hashes.view(np.int64))],
                    ["anchor", "content", "doc", "at", "place", "window"],
                )

    each = materialize(texts.mapInArrow(run, "anchor long, content long, doc long, at int, place int, window long"))
    keys = ["anchor", "place", "window"]
    best = materialize(each.groupBy(*keys).agg(F.min(F.struct("doc", "at")).alias("best"), F.count("*").alias("rows")))
    found = met(each.select("anchor", "content", "place", "window"), best.select(*keys, "best"), hot_keys(best, "rows"), keys, F.col("content"))
    return found.select("anchor", "content", F.col("place").alias("lo"), F.col("place").alias("hi"), "best.doc", "best.at").dropDuplicates(["anchor", "content", "lo"])


def first_occurrences(docs: DataFrame, kind: type, resolve: Callable, many: int = MANY_CLASSES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The segments whose anchors repeat, the classes with how many segments they have, and for each class runs of windows with their first occurrence.

    A run (lo, hi, doc, at): the windows that start lo to hi symbols before the
    anchor occur first where the anchor of document ``doc`` is at ``at``.
    ``resolve(table, kind)`` finds these for a shard's classes.
    """
    own = segments(docs, kind)
    repeated = materialize(anchor_counts(docs, kind).groupBy("anchor").agg(F.sum("times").alias("rows")).where("rows > 1"))
    own = materialize(met(own, repeated.select("anchor"), hot_keys(repeated, "rows"), ["anchor"], F.col("content")))
    first = F.min(F.struct("doc_id", (F.col("start") + F.col("offset")).alias("at"), "place", "body")).alias("first")
    classes = materialize(own.select("*", *unpacked(F.col("place"))).groupBy("anchor", "content").agg(first, F.count("*").alias("rows")))
    kinds = materialize(classes.groupBy("anchor").agg(F.count("*").alias("k")))
    several = met(classes.select("anchor", "content", "first"), kinds, hot_keys(kinds, "k"), ["anchor"], F.col("content"))
    texts = materialize(class_texts(docs, several, kind))
    size = texts.agg(F.coalesce(F.sum(F.length("symbols")), F.lit(0))).first()[0]
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    dealt = texts.where(F.col("k") <= many).withColumn("shard", F.pmod("anchor", F.lit(shards)))
    indexed = dealt.groupBy("shard").applyInArrow(lambda table: resolve(table, kind()), CLASS)
    return own, classes, materialize(indexed.unionByName(one_by_one(texts.where(F.col("k") > many), kind)))


def removals(docs: DataFrame, kind: type, resolve: Callable, earlier: Callable[[Column, Column, Column, Column], Column], many: int = MANY_CLASSES) -> DataFrame:
    """The symbols to remove from each text that loses some: doc_id, body, ranges (start, end exclusive)."""
    own, classes, runs = first_occurrences(docs, kind, resolve, many)
    keys, k = ["anchor", "content"], kind.k
    hit = met(own, runs.withColumnRenamed("at", "best_at"), hot_keys(classes, "rows"), keys, F.xxhash64("doc_id", "place"))
    hit = hit.select("doc_id", "body", "times", "lo", "hi", "doc", "best_at", *unpacked(F.col("place")))
    at = F.col("start") + F.col("offset")
    # Of segments that follow themselves, the later ones may repeat the first.
    gone = lambda shift: F.coalesce(earlier(F.col("doc"), F.col("best_at"), F.col("doc_id"), at + shift), F.lit(False))
    first, later = gone(F.lit(0)), gone(F.col("n")) & (F.col("times") > 1)
    a = F.greatest(F.col("start"), at - F.col("hi")) + F.when(first, 0).otherwise(F.col("n"))
    b = F.least(F.col("start") + F.col("n") - 1, at - F.col("lo")) + k + (F.col("times") - 1) * F.col("n")
    ranges = hit.where(first | later).select("doc_id", "body", a.alias("a"), b.alias("b")).where(F.col("b") - F.col("a") >= k)
    listed = ranges.groupBy("doc_id", "body").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("r"))
    return materialize(listed.select("doc_id", "body", merged(F.col("r")).alias("ranges")))


def merged(ranges: Column) -> Column:
    """Sorted ranges (a, b), those that touch as one."""

    def joined(s: Column, reach: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(x["a"] > F.get(reach, i - 1), F.lit(True)), i)), lambda i: i.isNotNull())
        ends = lambda h, j: F.get(reach, F.coalesce(F.get(h, j + 1), F.size(s)) - 1)
        return let(heads, lambda h: F.transform(h, lambda i, j: F.struct(F.get(s, i)["a"].alias("a"), ends(h, j).alias("b"))))

    return let(ranges, lambda s: let(running(F.transform(s, lambda x: x["b"]), lambda x, y: F.greatest(x, y)), lambda reach: joined(s, reach)))


def without(docs: DataFrame, removed: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Apply ``function(texts, ranges)``, which gives record-batch columns, to every document."""
    rows = docs.select("doc_id", "text", body().alias("body")).join(removed.hint("merge"), ["doc_id", "body"], "left").select("doc_id", "text", "ranges")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                ranges = [([x["a"] for x in r or []], [x["b"] for x in r or []]) for r in _column(part, "ranges").to_pylist()]
                yield pa.RecordBatch.from_arrays([_column(part, "doc_id"), *function(_column(part, "text").to_pylist(), ranges)], names)

    return rows.mapInArrow(run, schema)
