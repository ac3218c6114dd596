"""Benchmark decontamination: a prefix-filtered set join of item windows with texts.

Method: the windows of 13 words of every item are sets of shingles, to be
contained whole. Shingles are ordered by rarity, counted over all texts; since
containment is exact, the necessary prefix of a window is its one rarest
shingle. Prefix shingles are joined with the texts' shingles; where they meet,
position and length bound the window's place, and the whole window is compared.
A first pass counts the items' shingles, a second joins; texts aren't shuffled.

Items are taken in blocks of at most ``BLOCK_WORDS`` words, so what goes to the
workers is bounded whatever the benchmark's size; further blocks add to the
same rows. Null and blank texts have no words. Items without words have no
windows; items without an id count for hits but aren't listed. Repeated rows,
null keys and extra columns are kept as they are; with no items nothing is hit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinity.llm import window_scan
from affinity.llm.common import row_of, text_slices

BLOCK_WORDS = 300_000
SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("run_starts", T.ArrayType(T.IntegerType())),
        T.StructField("run_ends", T.ArrayType(T.IntegerType())),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)
FOUND = SCHEMA.names


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple]]:
    """The items in runs of at most so many words (or one longer item), streamed through the driver."""
    part, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len(window_scan.words(row["text"]))
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append((row["item_id"], row["text"]))
        size += n
    yield part


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def shingle_counts(docs: DataFrame, block: window_scan.Block) -> dict[tuple[int, int], int]:
    """How often each shingle of the block stands in all texts; as many as the block has at most."""
    vocabulary, base, keys = block.vocabulary, block.base, block.keys

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = window_scan.Reader(vocabulary, base), Counter()
        for batch in batches:
            for part in text_slices(batch):
                ids, _ = reader.read(_column(part, "text").to_pylist())
                for s, own in keys.items():
                    _, k = reader.find(ids, s, own)
                    total.update({(s, int(own[i])): int(n) for i, n in enumerate(window_scan.np.bincount(k)) if n})
        rows = [(s, k, n) for (s, k), n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["s", "k", "n"])

    counted = docs.select("text").mapInArrow(count, "s long, k long, n long").groupBy("s", "k").agg(F.sum("n").alias("n"))
    return {(r["s"], r["k"]): r["n"] for r in counted.collect()}  # bounded by BLOCK_WORDS


def hits(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """For each document: doc_id, n_words, the runs of hit words (start, end exclusive) and the items that hit it."""
    return _with_hits(docs.select(F.struct("doc_id").alias("row"), "text"), benchmark, most).select("row.doc_id", *FOUND)


def keep(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """The documents that hold no full window of an item and aren't contaminated, with all their columns.

    A long document is dropped for one passage of 13 words too; a word or two of
    a short item, which any text may hold, count only by their share.
    """
    found = _with_hits(docs.select(row_of(docs).alias("row"), "text"), benchmark, most)
    return found.where(~(contaminated() | holds_passage())).select("row.*")


def _with_hits(rows: DataFrame, benchmark: DataFrame, most: int) -> DataFrame:
    """Adds what was found to rows that have a text and whatever goes with it as ``row``."""
    found, texts = rows, rows.select("text")
    for items in blocks(benchmark, most):
        block = window_scan.Block(items)
        found = found.mapInArrow(_scanner(block.index(shingle_counts(texts, block))), T.StructType([rows.schema["row"], rows.schema["text"], *SCHEMA]))
    return found


def _scanner(index: window_scan.Index):
    """Adds a block's hits to rows that may have those of earlier blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                own = index.hits(_column(part, "text").to_pylist())
                runs, names = [(a, b) for _, a, b, _ in own], [[index.names[i] for i in x] for *_, x in own]
                if "run_starts" in part.schema.names:
                    old = [_column(part, n).to_pylist() for n in ("run_starts", "run_ends", "item_ids")]
                    runs = [window_scan.joined_runs(*r, a, b) for r, a, b in zip(runs, old[0], old[1], strict=True)]
                    names = [sorted({*n, *o}) for n, o in zip(names, old[2], strict=True)]
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        _column(part, "row"), _column(part, "text"), pa.array([n for n, *_ in own], pa.int64()),
                        pa.array([r[0] for r in runs], ints), pa.array([r[1] for r in runs], ints), pa.array(names, pa.list_(pa.string())),
                    ],
                    ["row", "text", *FOUND],
                )

    return run


def n_hit() -> Column:
    """How many words lie in the hit runs."""
    return F.aggregate(F.zip_with("run_ends", "run_starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated() -> Column:
    """Whether a twentieth of the words at least, and one at least, is hit."""
    return (n_hit() > 0) & (n_hit() * 20 >= F.col("n_words"))


def holds_passage() -> Column:
    """Whether a hit run has as many words as a full window."""
    return F.exists(F.zip_with("run_ends", "run_starts", lambda b, a: b - a), lambda n: n >= window_scan.WINDOW)


def judge(found: DataFrame) -> DataFrame:
    """The counts, the digest of items and the verdict (a twentieth of the words hit) for the result of ``hits``."""
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def judge_sql() -> str:
    """DuckDB SQL of ``judge(hits(documents, benchmark))``."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({low}, '{word}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({low}, '{word}') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS x
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM i),
t AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)),
o AS (SELECT r, n, k, item_id FROM t JOIN i USING (n, x)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM o) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS v FROM (SELECT DISTINCT r, item_id::VARCHAR AS v FROM o WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(v, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)"""
