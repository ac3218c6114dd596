"""Suffix-array dedup over bytes: deep-shallow sorting.

Method: in every shard the suffixes of the classes of segments (see ``repeats``)
that start at an anchor are sorted, and so are their reversed prefixes: multikey
quicksort to a shallow depth, blind tries below it. Neighbours' common prefixes
then tell, for every place of a window around the anchor, which classes hold the
same 100 bytes; the first occurrence among them is the window's.

A window's copy is removed where the same bytes start earlier: in a document of
smaller id, or earlier in the same one; overlaps count. Null text is empty; texts
of under 100 bytes lose nothing. Removal is by bytes, so what is left may cut a
character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from affinity.llm import anchors, repeats, suffix_sort

DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Side:
    """Suffixes on one side of the anchors, sorted, and their groups at any depth."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, most: int):
        self.order = suffix_sort.sort_suffixes(data, starts, ends, group)
        self.common = suffix_sort.common_prefixes(data, starts[self.order], ends[self.order], most)
        own = group[self.order]
        self.common[np.append(True, own[1:] != own[:-1])] = -1

    def groups(self, depth: int) -> np.ndarray:
        """A number for each suffix, the same for those of one anchor that agree so far."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < depth)
        return out


def resolve(table: pa.Table, kind) -> pa.Table:
    """The first occurrence of every window of a shard's classes, from their sorted suffixes."""
    k = kind.k
    table = repeats.once(table)
    n, offset, at = (np.array(table[x].to_pylist(), np.int64) for x in ("n", "offset", "at"))
    docs = np.array(table["doc"].to_pylist(), np.int64)
    data = np.frombuffer(b"".join(table["symbols"].to_pylist()), np.uint8)
    size = n + k - 1
    begin = np.cumsum(size) - size
    _, group = np.unique(np.array(table["anchor"].to_pylist(), np.int64), return_inverse=True)
    right = Side(data, begin + offset, begin + size, group, k)
    total = len(data)
    left = Side(np.ascontiguousarray(data[::-1]), total - (begin + offset), total - begin, group, k)
    where, place, best = [], [], []
    for j in range(int((offset - n + 1).min()), int(offset.max()) + 1):
        own = np.flatnonzero((offset - n + 1 <= j) & (j <= offset))
        if len(own):
            same = right.groups(k - j)[own] * (len(n) + 1) + left.groups(j)[own]
            where.append(own)
            place.append(np.full(len(own), j))
            best.append(own[anchors.earliest(same, docs[own], at[own])])
    where, place, best = np.concatenate(where), np.concatenate(place), np.concatenate(best)
    order = np.lexsort((place, where))
    where, first, last, best = anchors.runs_of(best[order], where[order], place[order])
    taken = pa.array(where)
    ints = [pa.array(x.astype(np.int32)) for x in (first, last)]
    return pa.table(
        [table["anchor"].take(taken), table["content"].take(taken), *ints, pa.array(docs[best]), pa.array(at[best].astype(np.int32))],
        ["anchor", "content", "lo", "hi", "doc", "at"],
    )


def removed(docs: DataFrame, many: int = repeats.MANY_CLASSES) -> DataFrame:
    """The bytes to remove: doc_id, ranges; documents that lose none have no row."""
    earlier = lambda doc, best, own, at: (doc < own) | ((doc == own) & (best < at))
    return repeats.removals(docs, anchors.ByteSymbols, resolve, earlier, many)


def _kept(text: str | None, ranges: tuple) -> tuple[int, int, int, bytes]:
    data = (text or "").encode()
    if not ranges[0]:
        return len(data), 0, 0, data
    mask, spans = anchors.covered(len(data), *ranges)
    return len(data), int(mask.sum()), spans, np.frombuffer(data, np.uint8)[~mask].tobytes()


def dedup(docs: DataFrame, many: int = repeats.MANY_CLASSES) -> DataFrame:
    """What is left of each document: doc_id, data (binary)."""

    def run(texts: list, ranges: list) -> list[pa.Array]:
        return [pa.array([_kept(t, r)[3] for t, r in zip(texts, ranges, strict=True)], pa.binary())]

    return repeats.without(docs, removed(docs, many), run, "doc_id long, data binary")


def digests(docs: DataFrame, many: int = repeats.MANY_CLASSES) -> DataFrame:
    """The counts of bytes, removed bytes and removed runs, and the SHA-256 of what is left."""

    def run(texts: list, ranges: list) -> list[pa.Array]:
        rows = [_kept(t, r) for t, r in zip(texts, ranges, strict=True)]
        return [*[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string())]

    return repeats.without(docs, removed(docs, many), run, DIGEST)


def digests_sql() -> str:
    """DuckDB SQL of ``digests(documents)``; windows are cut from pieces of the text's hexadecimal form and met by their MD5."""
    return r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
c AS (SELECT r, doc_id, o, substr(hx, 2 * o + 1, 4198) AS part FROM (SELECT r, doc_id, hx, unnest(range(0, greatest(length(hx) // 2 - 99, 0), 2000)) AS o FROM d)),
t AS (SELECT r, doc_id, o + k AS k, md5_number(substr(part, 2 * k + 1, 200)) AS x FROM (SELECT r, doc_id, o, part, unnest(range(0, least(2000, length(part) // 2 - 99))) AS k FROM c)),
f AS (SELECT x, min(ROW(doc_id, k)) AS first FROM t GROUP BY x HAVING count(*) > 1),
g AS (SELECT r, k FROM t JOIN f USING (x) WHERE ROW(doc_id, k) > first),
n AS (SELECT r, k, coalesce(k > lag(k) OVER w + 100, true) AS head FROM g WINDOW w AS (PARTITION BY r ORDER BY k)),
s AS (SELECT r, min(k) AS a, max(k) + 100 AS b FROM (SELECT r, k, sum(head::INT) OVER (PARTITION BY r ORDER BY k) AS run FROM n) GROUP BY r, run),
p AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM s),
v AS (SELECT r, string_agg(substr(hx, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS gone, count(*) AS spans FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(hx) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN last IS NULL THEN hx ELSE kept || substr(hx, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN v USING (r)"""
