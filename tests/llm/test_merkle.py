"""The manifest against a plain tree, over partitions of few leaves."""

import itertools
import random
import zlib
from hashlib import sha256

import pytest

from affinity.llm import merkle, merkle_forest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    """The root, and for each leaf its siblings level by level as (left, right)."""
    paths, at = [[] for _ in leaves], list(range(len(leaves)))
    level = leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 2 * 2 : i // 2 * 2 + 2]
            paths[k].append(("".join(run[: i % 2]), "".join(run[i % 2 + 1 :])))
            at[k] = i // 2
        level = [h("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def plain(rows):
    """The manifest of rows (doc_id, text, lang, source, n_chars)."""
    out, roots = [], []
    make = lambda r, n: h("".join(map(field, (r[0], r[3], r[2], n, r[1]))))
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    for lang in sorted({r[2] for r in rows}, key=first):
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (first(r[0]), make(r, r[4])))
        root, paths = tree([make(r, r[4]) for r in own])
        roots.append((root, own, paths))
    if not roots:
        return []
    whole, above = tree([r[0] for r in roots])
    for (root, own, paths), rest in zip(roots, above, strict=True):
        for r, path in zip(own, paths, strict=True):
            value = leaf = make(r, r[4])
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                value = make(r, r[4] + 1)
            for a, b in path + rest:
                value = h(a + value + b)
            out.append((r[0], leaf, root, whole, h("".join(a + b for a, b in path + rest)), value, value == whole))
    return out


def table():
    draw = random.Random(5)
    langs = [None, "", "v", "de", "en", "ü", "\U0001f600", "ﬁ"]
    rows = [(i, f"text {i} é", draw.choice(langs[3:5]), draw.choice("ab"), i) for i in range(61)]
    rows += [(draw.randrange(40), draw.choice(["", None, "x"]), draw.choice(langs), None, draw.choice([None, 3])) for _ in range(30)]
    rows += [(None, "no id", "de", "a", 5), (None, None, None, None, None), (1 << 62, "y" * 100_000, "solo", "a", (1 << 63) - 1)]
    return rows + [(7, "same", "en", "a", 4)] * 5


@pytest.mark.parametrize("leaves,fan", [(50_000, 16), (3, 2), (7, 3)])
def test_manifest(spark, monkeypatch, leaves, fan):
    monkeypatch.setattr(merkle, "PART_LEAVES", leaves)
    monkeypatch.setattr(merkle, "FAN", fan)
    rows = table()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "'x' AS `a.b`", "2 AS leaf", "3 AS grp", "4 AS at")
    got = [tuple(r) for r in merkle.manifest(docs.repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    assert sum(not r[6] for r in got) > 3


def test_few_rows(spark):
    for rows in ([], [(14, None, None, None, None)], [(3, "a", "de", "s", 1)]):
        got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()]
        assert got == plain(rows)


@pytest.mark.parametrize("arity,size", list(itertools.product([2, 3], [1, 2, 3, 10, 64])))
def test_merges_in_any_order(arity, size):
    """However leaves are split and fragments are merged, the same node is left; paths fold to it."""
    leaves = [(0, i, h(str(i))) for i in range(size)]
    (top,), siblings = merkle_forest.resolve(leaves, size, arity)
    draw = random.Random(size)
    for _ in range(5):
        parts = [merkle_forest.resolve(leaves[a:b], size, arity)[0] for a, b in itertools.pairwise(sorted({0, size, *(draw.randrange(size) for _ in range(4))}))]
        assert all(len([x for x in p if x[0] == level]) <= 2 * (arity - 1) for p in parts for level in range(8))
        while len(parts) > 1:
            a, b = (parts.pop(draw.randrange(len(parts))) for _ in range(2))
            parts.append(merkle_forest.resolve(a + b, size, arity)[0])
        assert parts[0] == [top]
    for level, i, value in leaves:
        end = merkle_forest.climb(level, i, siblings, arity)
        assert end[:2] == top[:2] and merkle_forest.fold(value, end[2]) == top[2]
