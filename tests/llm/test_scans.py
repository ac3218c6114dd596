"""Secret and PII scans against plain Python over small fixtures."""

import hashlib
import random
import re

import duckdb
import regex
from pyspark.sql import functions as F

from affinity.llm import pii, secret_scan
from affinity.llm import spans as span_type

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def secrets(text):
    text = text or ""
    found = [("assign", m) for m in ASSIGN.finditer(text) if len(m[2]) >= 8 and m[1].isascii()]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    return [(k, m.start(), m.end()) for k, m in sorted(found, key=lambda x: (x[1].start(), order.index(x[0])))]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    text = text or ""
    d = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", m) for m in EMAIL.finditer(text)]
    found += [("ip", m) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in CARD.finditer(text) if 13 <= len(d(m)) <= 19 and luhn(d(m))]
    found += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(d(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()


PARTS = [
    "password", "Api_Key", "apikey", "SECRET", "token", "ſecret", "=", ": ", ' "', "'", "abcdefgh", "a1b2c3d4e5f60718293a4b5c6d7e8f90", "AKIA", "ABCDEFGH1234", "é", "🙂", " ", "\n", ".",
    "@", "mail.example", "a.b", "-", "+", "4111 1111 1111 1111", "4111111111111112", "1.2.3.4", "256.1.1.1", "001.02.3.255", "+49 (30) 123-4567", "12", "0",
]


def rows():
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(40))) for _ in range(300)]
    texts += [None, "", "password: token: abcdefgh", "token = " + "x" * 5000, "1.2.3.4.5.6.7.8", "9" * 4000, "1 " * 4000, "a@" + "b." * 3000 + "c", "secret=abcdefg"]
    return [(i, t, f"src{i % 3}", "en", "x") for i, t in enumerate(texts)] + [(0, texts[0], "src0", "en", "x"), (None, "token=abcdefgh", None, None, None)]


SCHEMA = "doc_id long, text string, source string, lang string, spans string"


def test_secrets(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = secret_scan.digests(secret_scan.scan(docs)).collect()
    texts = {r[0]: r[1] for r in rows()}
    assert len(got) == len(rows())
    for r in got:
        want = secrets(texts[r.doc_id])
        assert (r.base_sha256, r.n_assign) == (digest(want), sum(k == "assign" for k, *_ in want)), texts[r.doc_id]
        assert set(f"{k}:{a}:{b}" for k, a, b in want) <= set(r.spans.split(","))
    assert secret_scan.digests(secret_scan.scan(docs.limit(0))).count() == 0


def test_ownership(spark):
    """Values of three owners, or of six repositories of two, are examples; a varied one of few is live, an even one dull."""
    leak, example, copied, few, even = "Zq9xW3bT7mK1vR5cN8yL2hG4sD6f", "Ab1c2D3e4F5g6H7i8J9k0L1m", "Qw7e8R5t6Y3u4I1o2P9a0S8d7", "Mn4b5V6c7X8z9L1k2J3h4G5f", "12abab12abab12abab12abab12"
    langs = ["en", "de", "fr", "es", "it", "nl"]
    data = [(i, f"see {example} here", f"src{i}", "en", "") for i in range(5)] + [(9, f"é {leak}", "src1", "en", "")]
    data += [(20 + i, f"see {copied} here", f"src{i % 2}", lang, "") for i, lang in enumerate(langs)]
    data += [(30 + i, f"see {few} here", "src1", lang, "") for i, lang in enumerate(langs[:5])]
    data += [(40, f"see {even} here", "src1", "en", ""), (41, f"token={leak} secret={example} password={'ab' * 6}", "src1", "en", "")]
    got = {r.doc_id: r for r in secret_scan.digests(secret_scan.scan(spark.createDataFrame(data, SCHEMA))).collect()}
    assert {i: r.spans for i, r in got.items() if i != 41} == {
        **{i: "" for i in (0, 1, 2, 3, 4, 20, 21, 22, 23, 24, 25, 40)}, 9: "token:2:30", **{30 + i: "token:4:28" for i in range(5)},
    }
    assert (got[41].n_assign, got[41].n_live, got[41].n_example, got[41].n_dull) == (3, 1, 1, 1)


def test_secrets_sql(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).where("length(text) < 1000 AND doc_id IS NOT NULL AND doc_id > 0")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example", "n_dull"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({secret_scan.scan_sql()})").fetchall())
    assert sorted(map(tuple, secret_scan.digests(secret_scan.scan(docs)).select(*names).collect())) == want


def test_many_matches_in_one_text(spark):
    """100,000 spans of one text are found and redacted in time that grows little more than in proportion."""
    n = 100_000
    docs = spark.createDataFrame([(1, "1.2.3.4 " * n, "s", "en", ""), (2, "password=abcdefgh1 " * n, "s", "en", ""), (3, "1" * n + "@ " + "a" * n + " x@" + "b-" * n, "s", "en", "")], SCHEMA)
    found = {r.doc_id: r for r in pii.digests(pii.detect(docs, pii.Model([], 0.0))).collect()}
    assert (found[1].n_ip, found[2].n_ip, found[1].spans.rsplit(",", 1)[1]) == (n, 0, f"ip:{8 * n - 8}:{8 * n - 1}")
    assert {r.text for r in pii.redact(docs.where("doc_id = 1"), pii.Model([], 0.0)).collect()} == {"[IP] " * n}
    assert {r.doc_id: r.n_assign for r in secret_scan.digests(secret_scan.scan(docs)).collect()} == {1: 0, 2: n, 3: 0}


def test_spans_apart_and_replaced(spark):
    """Spans that touch no others, and the replacement of overlapping ones, against plain Python."""
    rng = random.Random(7)
    text = "aé🙂 bc\n" * 300
    some = lambda n: sorted((a, min(len(text), a + rng.randrange(1, 40))) for a in rng.choices(range(len(text)), k=n))
    data = [(i, text, some(rng.randrange(20)), some(rng.randrange(6))) for i in range(40)]
    wide = lambda spans: [("k", a, b, str(a)) for a, b in spans]
    frame = spark.createDataFrame([(i, t, wide(x), wide(y)) for i, t, x, y in data], f"i int, text string, x array<{span_type.SPAN}>, y array<{span_type.SPAN}>")
    got = frame.select("i", span_type.untouched(frame["x"], frame["y"]).alias("free"), span_type.replaced(frame["text"], frame["x"], lambda s: F.concat(F.lit("<"), s["value"], F.lit(">"))).alias("out"))
    for r in got.collect():
        _, _, x, y = data[r.i]
        assert sorted((s.start, s.end) for s in r.free) == sorted((a, b) for a, b in x if not any(c < b and a < d for c, d in y))
        out, at, k = [], 0, 0
        while k < len(x):
            a, b = x[k]
            out += [text[at:a], f"<{a}>"]
            while k < len(x) and x[k][0] < max(b, a + 1):
                b = max(b, x[k][1])
                k += 1
            at = b
        assert r.out == "".join(out) + text[at:]


def test_personal(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    texts = {r[0]: r[1] for r in rows()}
    detected = pii.detect(docs, pii.Model([], 0.0))
    for r in pii.digests(detected).collect():
        assert r.base_sha256 == digest(personal(texts[r.doc_id])), texts[r.doc_id]
    assert pii.digests(pii.detect(docs.limit(0))).count() == 0


def test_redaction_and_trees(spark):
    rng = random.Random(5)
    bait = ["call +49 30 1234567 now", "mail to a.b@c.de today", "no 123456789012 code", "x 4111111111111111 y", "at 10.0.0.1 é", "k 12.34.56.78.90 z"]
    data = [(i, " ".join(rng.choices(bait, k=3)), "s", "en", "") for i in range(400)]
    docs = spark.createDataFrame(data, SCHEMA)
    model = pii.fit(docs)
    assert model.trees
    for r in pii.redact(docs, model).collect():
        assert "@" not in r.text and "4111111111111111" not in r.text and "10.0.0.1" not in r.text
        assert r.text.replace("[EMAIL]", "").count("mail to ") == data[r.doc_id][1].count("mail to ")
    null = pii.redact(spark.createDataFrame([(1, None, "s", "en", "")], SCHEMA), model).first()
    assert null.text is None


def test_many_loose_spans_in_the_fitted_corpus(spark):
    """Spelled-out addresses and plain phones are redacted however many the fitted corpus holds; other numbers stay."""
    rng = random.Random(6)
    digit = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(3, 9)))
    strict = [lambda: f"call +49 {rng.randrange(30, 99)} {digit(7)} now", lambda: f"mail to {word()}.{word()}@{word()}.org today", lambda: "x 4111111111111111 y"]
    loose = [lambda: f"{word()} (at) {word()} (dot) org", lambda: f"030 {digit(4)} {digit(4)}", lambda: f"({rng.randrange(200, 999)}) {digit(3)}-{digit(4)}"]
    planted = {i: loose[i % 3]() for i in range(300)}
    data = [(i, f"{word()} {word()} {x} {word()}", "s", "en", "") for i, x in planted.items()]
    data += [(1000 + i, " ".join([word() for _ in range(20)] + [rng.choice(strict)()]), "s", "en", "") for i in range(300)]
    data += [(2000 + i, f"look (at) {word()} or {digit(11)} end", "s", "en", "") for i in range(50)]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(data, SCHEMA)).collect()}
    assert not [x for i, x in planted.items() if x.strip("(") in got[i]]
    assert not [got[i] for i in got if i >= 2000 and "[" in got[i]]


def plain_features(text, kind, a, b):
    """The features of a candidate, in plain Python."""
    value, before, after = text[a:b], text[max(0, a - pii.AROUND) : a], text[b : b + 1]
    count = lambda x: float(len(re.findall(x, value)))
    d = re.sub("[^0-9]", "", value)
    context = [float(bool(re.search(x, before.lower()))) for x in pii.CONTEXT.values()]
    domain = count(r"(?:@|(?:at|AT)[)\]])\x20?[A-Za-z0-9-]+(?:\.|\x20?[(\[](?:dot|DOT))")
    card = float(13 <= len(d) <= 19 and luhn(d))
    own = [float(kind == "email"), float(b - a), count("[0-9]"), count("[A-Za-z]"), count(" "), count(r"\."), count("-"), count("@"), count(r"\+"), card, count(r"[(\[]"), domain]
    return own + [float(bool(re.search("[A-Za-z0-9]$", before))), float(bool(re.match("[A-Za-z0-9]", after))), *context]


def plain_score(model, x):
    """The summed margin of the trees."""

    def value(node):
        if isinstance(node, float):
            return node
        feature, bound, low, high = node
        return value(low if x[feature] <= bound else high)

    return sum(w * value(tree) for w, tree in model.trees)


def test_added_spans_against_plain_scoring(spark):
    """The spans that the trees add are those that plain Python picks, span by span; some are added and some rejected."""
    rng = random.Random(11)
    digit = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(3, 9)))
    forms = [
        lambda: f"+49 {rng.randrange(30, 99)} {digit(7)}", lambda: f"{word()}.{word()}@{word()}.org", lambda: f"{word()} (at) {word()} (dot) org", lambda: f"030 {digit(4)} {digit(4)}",
        lambda: f"({rng.randrange(200, 999)}) {digit(3)}-{digit(4)}", lambda: digit(11), lambda: f"{digit(2)}.{digit(9)}", lambda: f"look (at) {word()}", lambda: f"20{digit(2)}-0{digit(1)}-1{digit(1)} 20{digit(2)}-0{digit(1)}-1{digit(1)}",
        lambda: "4111 1111 1111 1111", lambda: "10.2.3.4", lambda: "é🙂 " + word(),
    ]
    data = [(i, " ".join(f"{word()} {rng.choice(forms)()}" for _ in range(rng.randrange(1, 6))), "s", "en", "") for i in range(500)]
    docs = spark.createDataFrame(data, SCHEMA)
    model = pii.fit(docs)
    added = rejected = 0
    for r in pii.detect(docs, model).collect():
        text = data[r.doc_id][1]
        base = [(a, b) for _, a, b in personal(text)]
        loose = [(kind, m.start(), m.end()) for kind, pattern in pii.LOOSE.items() for m in regex.finditer(pattern, text)]
        want = set()
        for kind, a, b in loose:
            if not any(c < b and a < d for c, d in base):
                x = plain_features(text, kind, a, b)
                if plain_score(model, x) >= model.margin and (kind != "email" or x[pii.FEATURES.index("domain")] > 0):
                    want.add((kind, a, b))
                else:
                    rejected += 1
        assert {(s.kind, s.start, s.end) for s in r.added} == want, text
        added += len(want)
    assert added > 100 and rejected > 100
