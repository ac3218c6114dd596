"""Substring dedup over words: a compressed FM-index for each shard.

Method: every repeated segment (see ``repeats``) is indexed once in the FM-index
of its shard, a wavelet tree over the shard's Burrows-Wheeler transform. The
segments are streamed through backward search, which gives matching statistics
at every word, one step a window; where these reach the threshold of 13 words, the
interval's least document is the window's first. A shard is by content (anchor), so every copy of
a window meets in one, and a segment that thousands of documents share is
streamed once for all of them.

A window is removed from all documents but the one of least id. Null and blank
texts have no words; texts of fewer than 13 words lose none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from affinity.llm import anchors, fm_index, repeats

DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def resolve(table: pa.Table, kind) -> pa.Table:
    """The first document of every window of a shard's classes, by backward search in the shard's index."""
    k = kind.k
    table = repeats.once(table)
    n = table["n"].to_numpy().astype(np.int64)
    hashes = np.frombuffer(b"".join(table["symbols"].to_pylist()), np.uint64)
    sizes = n + k - 1
    _, numbers = np.unique(hashes, return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    owner = np.repeat(np.arange(len(n)), sizes)
    spot = np.arange(len(owner)) + owner  # a 0 ends each class
    symbols = np.zeros(begin[-1], np.int64)
    symbols[spot] = numbers + 1
    docs = table["doc"].to_numpy()
    index = fm_index.FMIndex(symbols, k, np.repeat(docs, sizes + 1))
    owner = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    best = index.least_label(index.stream(symbols, begin[:-1], n))
    where, first, last, doc = anchors.runs_of(best, owner, step)
    offset = table["offset"].to_numpy().astype(np.int64)[where]
    ints = [pa.array(x.astype(np.int32)) for x in (offset - last, offset - first)]
    taken = pa.array(where)
    at = pa.array(np.zeros(len(where), np.int32))
    return pa.table([table["anchor"].take(taken), table["content"].take(taken), *ints, pa.array(doc), at], ["anchor", "content", "lo", "hi", "doc", "at"])


def removed(docs: DataFrame, many: int = repeats.MANY_CLASSES) -> DataFrame:
    """The words to remove: doc_id, ranges; documents that lose none have no row."""
    return repeats.removals(docs, anchors.WordSymbols, resolve, lambda doc, _, own, __: doc < own, many)


def _kept(text: str | None, ranges: tuple) -> tuple[int, int, bytes]:
    words = (text or "").encode().split()
    if not ranges[0]:
        return len(words), 0, b" ".join(words)
    mask, _ = anchors.covered(len(words), *ranges)
    return len(words), int(mask.sum()), b" ".join([w for w, gone in zip(words, mask.tolist(), strict=True) if not gone])


def dedup(docs: DataFrame, many: int = repeats.MANY_CLASSES) -> DataFrame:
    """What is left of each document: doc_id, text (words joined by one space)."""

    def run(texts: list, ranges: list) -> list[pa.Array]:
        return [pa.array([_kept(t, r)[2].decode() for t, r in zip(texts, ranges, strict=True)], pa.string())]

    return repeats.without(docs, removed(docs, many), run, "doc_id long, text string")


def digests(docs: DataFrame, many: int = repeats.MANY_CLASSES) -> DataFrame:
    """The counts of words and removed words, and the SHA-256 of what is left."""

    def run(texts: list, ranges: list) -> list[pa.Array]:
        rows = [_kept(t, r) for t, r in zip(texts, ranges, strict=True)]
        return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())]

    return repeats.without(docs, removed(docs, many), run, DIGEST)


def digests_sql() -> str:
    """DuckDB SQL of ``digests(documents)``."""
    return r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, doc_id, k, array_to_string(w[k:k + 12], ' ') AS x FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
f AS (SELECT x, min(doc_id) AS first FROM t GROUP BY x),
c AS (SELECT DISTINCT r, unnest(range(k, k + 13)) AS p FROM t JOIN f USING (x) WHERE first < doc_id),
v AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT v.r, string_agg(v.x, ' ' ORDER BY v.p) AS kept, count(*) AS n FROM v LEFT JOIN c ON c.r = v.r AND c.p = v.p WHERE c.p IS NULL GROUP BY v.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""
