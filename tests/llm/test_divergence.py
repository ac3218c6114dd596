"""The divergence audit against plain counting."""

import random
import re
from collections import Counter, defaultdict

from affinity.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans(divergence.UPPER, divergence.LOWER)


def plain(rows, most=200):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(LOWER))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in seen if seen[t] >= 3]
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(t for t in words if t in set(kept))
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept)) for t in kept}
        sources = {d[1] for d in own}
        p = {s: share(counts[s]) for s in sources}
        q = share(sum((counts[s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ordered) if part == "pair" or k < most]
    return sorted(out)


def test_audit(spark):
    draw = random.Random(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["É", "é", "ABC", "abc", "ﬁn", "\U0001f600", "日本"]
    rows = []
    for i in range(160):
        text = " ".join(draw.choice(words[: 40 + 90 * (i % 4)]) + draw.choice(["", "1", "-x", "\x00", "\n"]) for _ in range(draw.randrange(60)))
        rows.append((i, text, draw.choice(["de", "en"]), draw.choice("aaaabc"), i))
    rows += [(1, "same words here", "fr", "s", 1)] * 4 + [(None, None, None, None, None), (3, "", "it", "a", 0), (4, "rare", "it", "b", 0), (5, "123 _", "it", None, 0), (6, "once", "", "é", 0)]
    rows += [(9, "long text " * 50_000, "fr", "t", 0), (9, "same words", "fr", "t", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS term", "2 AS counts", "3 AS `a.b`", "4 AS salt")
    got = [tuple(r) for r in divergence.audit(docs.repartition(3)).collect()]
    assert sorted(got) == plain(rows)
    assert {r[4] for r in got if r[0] == "it"} == {0}
    assert max(r[5] for r in got if r[2] == "term") > 20


def test_only_the_first_ranks(spark):
    rows = [(i, " ".join("x" * (k % 17 + 1) + chr(97 + k % 26) + "yz" * (k % 7) for k in range(400)) if i < 3 else "xa " * 40, "en", "ab"[i > 2], 0) for i in range(4)]
    got = [tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == plain(rows)
    assert sum(r[1:3] == ("a", "term") for r in got) == 200


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shares_of_large_counts(spark):
    """Counts beyond what a product with the scale could hold."""
    cases = [(0, 5, 3), (10**13, 10**15, 7), (4_000_000_000_000_000, 8_999_999_999_999_999, 10**6), (8, 9, 1)]
    got = spark.createDataFrame(cases, "n long, total long, kept long").select(divergence.share(*map(divergence.F.col, ("n", "total", "kept"))).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in cases]
