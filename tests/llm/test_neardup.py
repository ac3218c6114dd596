"""MinHash near-dedup against all pairs."""

import random
import re

import corpus_pipeline
from affinity.llm import neardup


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in docs if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((i, len(x), find(i) if i is not None else None, i is None or find(i) == i) for i, x in sets), key=str)


def test_family(spark):
    """A family of which many are like others, but not like the centre: the bounded remainder finds all links."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    docs = []
    for k in range(120):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 5, 6])):
            own[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        docs.append(" ".join(own))
        if k % 4 == 0:
            own[rng.randrange(150)] = "y"
            docs.append(" ".join(own))
    docs = list(enumerate(docs))
    want = {r[0]: r[2] for r in brute(docs)}
    assert 20 < len(set(want.values())) < 120
    got = neardup.cluster(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_brute(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randrange(1, 5)))
    docs = []
    for family in range(25):
        base = [word() for _ in range(rng.choice([1, 2, 3, 8, 9, 30, 60, 120]))]
        for _ in range(rng.randrange(1, 7)):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = word()
            docs.append(" ".join(own))
            if rng.random() < 0.3:
                docs.append(docs[-1].upper().replace("É", "é") + "\n")
    rng.shuffle(docs)
    docs = list(enumerate(docs, 5)) + [(1000, None), (1001, " "), (1002, ""), (None, docs[0])]
    docs.append(docs[3])
    docs.append((docs[3][0], docs[9][1]))  # another text of one id
    want = {}
    for row in brute(docs):
        want[row[0]] = row
    got = neardup.cluster(spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, node int"))
    rows = got.collect()
    assert len(rows) == len(docs)
    same = {r.doc_id for r in rows if r.doc_id in want}
    assert same == set(want)
    for r in rows:
        assert (r.component_id, r.kept) == want[r.doc_id][2:], r
    kept = neardup.keep(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _, k in want.values() if k}
    assert neardup.cluster(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_links_block_edits_and_scattered_ones(spark):
    """A block of six edited words is alike in five words only, two single edits in three words only; both copies go."""
    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    block, scattered = words("a", 100), words("b", 90)
    edited = block[:47] + words("x", 6) + block[53:]
    single = [f"y{k}" if k in (30, 60) else w for k, w in enumerate(scattered)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((block, edited, scattered, single, words("c", 50)))] + [(None, "d")], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {0, 2, 4, None}
