"""Benchmark decontamination against plain Python."""

import random
import re

from affinity.llm import decontam, window_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for item, text in items:
            b = words(text)
            n = min(13, len(b))
            windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    names.update([str(item)] if item is not None else [])
        out.append((i, len(w), len(hit), len(names), window_scan.digest(sorted(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_brute(spark):
    rng = random.Random(1)
    vocabulary = ["a", "B", "ç", "d1", "e", "漢"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 12, 13, 14, 30]))) for k in range(12)] + [(40, None), (41, " ,"), (None, text(15)), (3, text(20))]
    docs = []
    for k in range(80):
        inner = rng.choice([t for _, t in items if t])
        docs.append((k, text(rng.randrange(30)) + inner + text(rng.randrange(30)) if k % 3 else text(80)))
    docs += [(100, None), (101, ""), (7, docs[7][1]), (None, items[5][1]), (102, "x " * 5000)]
    frame = spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, doc_id long")
    for most in (10**6, 25):
        got = sorted(map(tuple, decontam.judge(decontam.hits(frame, bench, most)).collect()), key=str)
        assert got == brute(docs, items)
    assert decontam.judge(decontam.hits(frame.limit(0), bench)).count() == 0
    assert {r.n_hit for r in decontam.judge(decontam.hits(frame, bench.limit(0))).collect()} == {0}
