"""Substring dedup over words and bytes against plain Python, and the parts of the indexes."""

import hashlib
import random

import numpy as np
import pytest

from affinity.llm import anchors, fm_index, substring_fm, substring_sa, suffix_sort


def brute_words(docs):
    first, out = {}, []
    split = {k: (t or "").encode().split() for k, (_, t) in enumerate(docs)}
    for k, (i, _) in enumerate(docs):
        for a in range(len(split[k]) - 12):
            if i is not None:
                w = tuple(split[k][a : a + 13])
                first[w] = min(i, first.get(w, i))
    for k, (i, _) in enumerate(docs):
        gone = set()
        for a in range(len(split[k]) - 12):
            if i is not None and first[tuple(split[k][a : a + 13])] < i:
                gone.update(range(a, a + 13))
        kept = b" ".join(w for a, w in enumerate(split[k]) if a not in gone)
        out.append((i, len(split[k]), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(docs):
    first, out = {}, []
    for i, t in docs:
        d = (t or "").encode()
        for a in range(len(d) - 99):
            if i is not None:
                first[d[a : a + 100]] = min((i, a), first.get(d[a : a + 100], (i, a)))
    for i, t in docs:
        d = (t or "").encode()
        gone = np.zeros(len(d) + 1, bool)
        for a in range(len(d) - 99):
            if i is not None and first[d[a : a + 100]] < (i, a):
                gone[a : a + 100] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abé", k=rng.randrange(1, 6)))
    text = lambda n: [word() for _ in range(n)]
    shared = [text(rng.choice([12, 13, 20, 60])) for _ in range(8)]
    docs = []
    for _ in range(60):
        own = []
        for _ in range(rng.randrange(1, 5)):
            own += text(rng.randrange(20)) + rng.choice(shared)[rng.randrange(4) :]
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = word()
        docs.append(rng.choice([" ", "\n"]).join(own))
    docs += docs[:6] + ["a " * 300, "ab" * 400, "a " * 200, "x" * 99, "x" * 100, "x" * 1000]
    docs = list(enumerate(docs))
    rng.shuffle(docs)
    return docs + [(500, None), (501, ""), (502, " "), (None, docs[0][1]), docs[1]]


@pytest.mark.parametrize("many", [10**6, 3])
def test_brute(spark, many):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, anchor int")
    assert sorted(map(tuple, substring_fm.digests(frame, many).collect()), key=str) == brute_words(docs)
    assert sorted(map(tuple, substring_sa.digests(frame, many).collect()), key=str) == brute_bytes(docs)


def test_texts_of_one_id(spark):
    """Each row of a repeated id loses what its own text repeats, however many texts the id has and however alike their hashes are."""
    shared, other = [f"s{k}" for k in range(20)], [f"o{k}" for k in range(20)]
    docs = [(0, " ".join(shared)), (1, " ".join([*shared, "a16"])), (1, " ".join([*other, "b449"]))]
    # The hashes of the last two agree in 18 bits.
    docs += [(7, f"{' '.join(shared) if k % 100 == 0 else ' '.join(other[k % 7 :])} tail {k}") for k in range(5000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, substring_fm.digests(frame).collect()), key=str) == brute_words(docs)
    assert sorted(map(tuple, substring_sa.digests(frame).collect()), key=str) == brute_bytes(docs)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_fm.dedup(none).count() == 0
    assert substring_sa.dedup(none).count() == 0


def test_suffix_sort():
    rng = random.Random(6)
    data = bytes(rng.choices(b"ab", k=300)) + b"abc" * 200
    starts = np.array(rng.choices(range(len(data)), k=400))
    ends = np.minimum(starts + np.array([rng.randrange(120) for _ in starts]), len(data))
    ends = np.array([max(e for s2, e in zip(starts, ends, strict=True) if s2 == s) for s in starts])
    group = np.array(rng.choices(range(3), k=400))
    order = suffix_sort.sort_suffixes(np.frombuffer(data, np.uint8), starts, ends, group)
    got = [(group[i], data[starts[i] : ends[i]]) for i in order]
    assert got == sorted(got)


def test_multikey_quicksort():
    """The shallow phase orders by so many bytes and names exactly the ties."""
    rng = random.Random(8)
    data = bytes(rng.choices(b"abc", k=500)) + b"aaaaaaaaab" * 20
    starts = np.arange(len(data))
    ends = np.full(len(data), len(data))
    group = np.zeros(len(data), np.int64)
    order, tied = suffix_sort.multikey_quicksort(np.frombuffer(data, np.uint8), starts, ends, group, 6)
    cut = [data[s : s + 6] for s in order]
    assert cut == sorted(cut)
    same = [(a, b) for a, b in tied]
    assert all(len({cut[k] for k in range(a, b)}) == 1 and b - a > 1 for a, b in same)
    assert sum(b - a for a, b in same) == sum(n for n in (cut.count(x) for x in set(cut)) if n > 1)


def test_fm_index():
    rng = np.random.default_rng(1)
    symbols = np.concatenate([np.append(rng.integers(1, 5, 200), 0) for _ in range(3)])
    labels = rng.permutation(len(symbols))
    index = fm_index.FMIndex(symbols, 6, labels)
    ends = np.arange(1, len(symbols))
    found, low, high = index.search(symbols, ends, 6)
    text = symbols.tolist()
    for e, f, a, b in zip(ends.tolist(), found.tolist(), low.tolist(), high.tolist(), strict=True):
        want = [s for s in range(len(text)) if text[s : s + f] == text[e - f : e] and len(text[s : s + f]) == f]
        assert b - a == len(want)
        if f == 6:
            assert index.least_label(np.array([a]))[0] == min(labels[s] for s in want)
    # Streams of windows, some of which the index doesn't have.
    index = fm_index.FMIndex(np.append(symbols[:300], 0), 6, labels[:301])
    begin, count = np.array([0, 150, 280, 350, 500]), np.array([40, 1, 60, 120, 97])
    got = iter(index.stream(symbols, begin, count).tolist())
    for b, n in zip(begin.tolist(), count.tolist(), strict=True):
        for w in range(b, b + n):
            found, low, _ = index.search(symbols, np.array([w + 6]), 6)
            assert next(got) == (low[0] if found[0] == 6 else -1)


def test_repeated_ids_with_other_texts(spark):
    """Texts of one id are one document: earlier is the smaller id, or the earlier start in any of its texts."""
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(40)}" for _ in range(n)]
    shared = text(30)
    docs = [(1, text(10) + shared), (1, text(5) + shared + text(20)), (2, shared + text(10)), (2, shared + text(10)), (3, text(40)), (4, shared[3:])]
    docs = [(i, " ".join(t)) for i, t in docs]
    docs += [docs[2], docs[2], (1, None), (9, "z" * 5000), (9, "y" + "z" * 3000)]
    frame = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, salt int, ranges int")
    assert sorted(map(tuple, substring_fm.digests(frame).collect()), key=str) == brute_words(docs)
    assert sorted(map(tuple, substring_sa.digests(frame).collect()), key=str) == brute_bytes(docs)


def test_periodic_text_makes_few_segments():
    for kind, text, most in ((anchors.ByteSymbols, "x" * 200_000, 2), (anchors.ByteSymbols, "abcdefg" * 30_000, 12), (anchors.WordSymbols, "a b " * 50_000, 6)):
        symbols = kind()
        found = anchors.Segments([symbols.read(text)], symbols)
        assert len(found.text) <= most
        assert int((found.n * found.times).sum()) == len(symbols.read(text)) - kind.k + 1


def test_long_text_is_cut_without_loss():
    symbols = anchors.ByteSymbols()
    read = symbols.read("".join(random.Random(3).choices("abcdef", k=5000)))
    parts = anchors.cut(read, 100, 700)
    assert sum(len(x) - 99 for _, x in parts) == 4901
    assert all((read[a : a + len(x)] == x).all() for a, x in parts)


def test_texts_are_shuffled_at_every_size(spark):
    """Few removals don't turn the last join into a broadcast, which larger tables couldn't follow."""
    docs = spark.createDataFrame([(i, " ".join(f"w{k + i % 3}" for k in range(30))) for i in range(40)], "doc_id long, text string")
    plan = substring_fm.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
