"""PII: candidate spans scored by boosted trees, thresholds calibrated, spans redacted.

Method: candidate gradient boosting. High-recall generators propose overlapping
spans: strict ones for e-mail addresses, IPv4 addresses, card and phone numbers,
and loose ones (spelled-out addresses, long digit groups). Boosted trees use
features of format (length, digits, separators, checks) and of context (the
characters and the words around). A candidate whose score reaches a threshold
calibrated for precision on held-out candidates is redacted. Strict spans that
pass their own checks always are.

The trees are fitted on the strict spans of at most ``SAMPLE_DOCS`` documents (the
lowest MD5 of id): their forms with the strict marks hidden (spelled out, without
a plus) against independent forms that are no personal data (an address without
a domain, wrong checks, plain runs of digits, dates, decimals). Loose spans
outside strict ones are no examples, so that it doesn't matter how many there
are. Half of the documents fit, half calibrate. The trees are then plain column expressions, so scoring and
redacting run within the row: no shuffle, no row is left out.

Null text is empty. Null keys, repeated rows and extra columns pass through; an
empty table, or a sample without both kinds of examples, fits no trees and
adds nothing. Plain runs of digits aren't told from other numbers and stay. Only
DataFrame functions and MLlib on DataFrames are used.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm import spans
from affinity.llm.common import let, materialize

# Fixed values of the contract: kinds in their order and their patterns.
KINDS = ["email", "ip", "card", "phone"]
# A local part or a number is read once, from its first character on: a run that fails isn't tried again from within.
LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
EMAIL = LOCAL + r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Loose generators, by kind.
LOOSE = {
    "email": LOCAL + r"(?:@|\x20?[(\[](?:at|AT)[)\]]\x20?)[A-Za-z0-9-]+(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]+)*+",
    "number": r"\+?[0-9](?:[\x20().-]{0,2}[0-9]){8,18}+",
}
CONTEXT = {"mail": "mail|contact|write", "call": "phone|call|tel|fax|mobil", "card": "card|visa|pay|iban|account"}
AROUND = 24
SAMPLE_DOCS = 20_000
TREES, DEPTH, PRECISION = 12, 3, 0.98


def digits(value: Column) -> Column:
    """The digits of a string."""
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def worth(i: Column) -> Column:
        digit = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda a, i: a + worth(i))
    return F.when(F.length(number) > 0, total % 10 == 0).otherwise(False)


def valid_ip(value: Column) -> Column:
    """Whether all dotted parts are 255 at most."""
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    small = lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(False)
    return F.forall(F.split(value, r"\."), small)


def valid_card(value: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn check."""
    return F.when(F.length(digits(value)).between(13, 19), luhn(digits(value))).otherwise(False)


def valid_phone(value: Column) -> Column:
    """Whether there are 9 to 15 digits."""
    return F.length(digits(value)).between(9, 15)


def base_spans(text: Column) -> Column:
    """The checked spans by kind, then start."""
    found = [
        F.when(F.instr(text, "@") > 0, spans.matches(text, EMAIL, "email")).otherwise(spans.none()),
        F.filter(spans.matches(text, IP, "ip"), lambda s: valid_ip(s["value"])),
        F.filter(spans.matches(text, CARD, "card"), lambda s: valid_card(s["value"])),
        F.filter(spans.matches(text, PHONE, "phone"), lambda s: valid_phone(s["value"])),
    ]
    return spans.ordered(F.concat(*found), KINDS, True)


def loose_spans(text: Column) -> Column:
    """The spans of the loose generators, which may overlap the others."""
    return F.concat(*[spans.matches(text, pattern, kind) for kind, pattern in LOOSE.items()])


FEATURES = ["email", "length", "digits", "letters", "blanks", "dots", "dashes", "at", "plus", "luhn", "brackets", "domain", "word_before", "word_after", *CONTEXT]


def features(cut: Column, span: Column) -> Column:
    """The features of a candidate: its format, and what stands around it in a text cut into pieces."""
    value = span["value"]
    count = lambda x: F.regexp_count(value, F.lit(x)).cast("double")
    before = spans.part(cut, F.greatest(span["start"] - AROUND, F.lit(0)), span["start"])
    after = spans.part(cut, span["end"], span["end"] + 1)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.array(
        flag(span["kind"] == "email"), F.length(value).cast("double"), count("[0-9]"), count("[A-Za-z]"), count(r"\x20"), count(r"\."), count("-"), count("@"), count(r"\+"),
        flag(valid_card(value)), count(r"[(\[]"), count(r"(?:@|(?:at|AT)[)\]])\x20?[A-Za-z0-9-]+(?:\.|\x20?[(\[](?:dot|DOT))"), flag(before.rlike("[A-Za-z0-9]$")), flag(after.rlike("[A-Za-z0-9]")), *[flag(F.lower(before).rlike(x)) for x in CONTEXT.values()],
    )


class Model:
    """Boosted regression trees as a column expression, and the calibrated margin."""

    def __init__(self, trees: list[tuple[float, object]], margin: float):
        self.trees, self.margin = trees, margin

    def score(self, x: Column) -> Column:
        """The summed margin of an array of features."""

        def value(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, bound, low, high = node
            return F.when(x[feature] <= bound, value(low)).otherwise(value(high))

        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + F.lit(weight) * value(tree)
        return total

    def picks(self, cut: Column, span: Column) -> Column:
        """Whether a candidate is to be redacted, in a text cut into pieces."""
        if not self.trees:
            return F.lit(False)
        # As with strict ones, an address without a dotted domain is none.
        return let(features(cut, span), lambda x: (self.score(x) >= self.margin) & ((x[0] == 0) | (x[FEATURES.index("domain")] > 0)))


def parse_tree(text: str):
    """A tree of MLlib's debug form: nested (feature, bound, low, high), or a leaf's value."""
    lines = iter([x.strip() for x in text.splitlines() if re.match(r"\s*(If|Else|Predict)", x)])

    def node():
        line = next(lines)
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        feature, bound = re.search(r"feature (\d+) <= ([-+.\dEe]+)", line).groups()
        low = node()
        next(lines)  # Else
        return int(feature), float(bound), low, node()

    return node()


def hidden_forms(span: Column) -> Column:
    """Loose forms of a base span, its strict marks hidden (label 1), and forms of its parts that are no personal data (label 0)."""
    value, d = span["value"], digits(span["value"])
    local, domain = F.regexp_extract(value, "^(.*)@", 1), F.regexp_extract(value, "@(.*)$", 1)
    short = F.substring_index(local, ".", -1)
    name, last = F.substring_index(domain, ".", 1), (F.right(d, F.lit(1)).cast("int") + 1) % 10
    part = lambda i, n: F.substr(d, F.length(d) - 9 + i, F.lit(n))  # noqa: E731  of the last ten digits
    good = {
        "email": [F.concat(who, F.lit(x), F.replace(domain, F.lit("."), F.lit(y))) for who in (local, short) for x, y in ((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("@", " (dot) "), (" (at) ", "."))],
        "phone": [
            F.substring(value, 2, 100), F.regexp_replace(F.regexp_replace(value, "[()]", ""), r"^\+[0-9]{1,3}[\x20.-]+", "0"),
            F.concat(F.lit("0"), part(0, 2), F.lit(" "), part(2, 4), F.lit(" "), part(6, 4)), F.concat(part(0, 3), F.lit(") "), part(3, 3), F.lit("-"), part(6, 4)), F.concat(part(0, 3), F.lit("-"), part(3, 3), F.lit("-"), part(6, 4)),
        ],
    }
    dates = F.concat(*[x for i in (0, 4) for x in (F.lit("20"), part(i, 2), F.lit("-0"), part(i + 2, 1), F.lit("-1"), part(i + 3, 1), F.lit(" " if i == 0 else ""))])
    wrong = F.concat(F.substr(value, F.lit(1), F.length(value) - 1), last.cast("string"))
    numbers = [F.concat(F.substr(d, F.lit(1), F.length(d) - 1), last.cast("string")), F.concat(F.left(d, F.lit(2)), F.lit("."), F.substr(d, F.lit(3), F.lit(20))), dates]
    bad = {
        "email": [F.concat(who, F.lit(x), name) for who in (local, short) for x in ("@", " (at) ", "(at)", " [at] ")],
        "ip": [F.regexp_replace(value, "^[0-9]+", "999")],
        "card": [wrong, *numbers],
        "phone": numbers,
    }
    out = F.array().cast("array<struct<value:string,label:double>>")
    for kind in KINDS:
        pattern = LOOSE["email" if kind == "email" else "number"]
        forms = [F.struct(x.alias("value"), F.lit(label).alias("label")) for label, some in ((1.0, good), (0.0, bad)) for x in some.get(kind, [])]
        fits = lambda f: f["value"].rlike(f"^(?:{pattern})$") & ((f["label"] == 1.0) | ~valid_card(f["value"]))  # noqa: B023, E731  called at once
        out = F.when(span["kind"] == kind, F.filter(F.array(*forms), fits)).otherwise(out)
    return out


def labelled(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """Examples from the base spans of a bounded sample of documents: x (features), label, held_out.

    What the loose generators find outside base spans is no example: nobody knows what it is.
    """
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(order).limit(most)
    text = F.coalesce("text", F.lit(""))
    # Written first, so that the patterns run over the sample alone. At most ``most`` ids are sent.
    sample = materialize(docs.join(F.broadcast(ids), "doc_id").select("doc_id", text.alias("text")))
    each = sample.select("doc_id", "text", F.explode(base_spans(F.col("text"))).alias("s"))
    start = F.col("s.start")
    near = F.substr("text", F.greatest(start - AROUND, F.lit(0)) + 1, F.least(start, F.lit(AROUND)))
    # Good forms stand where the span does and elsewhere in the text; the others only elsewhere.
    far = F.concat(F.substr("text", F.pmod(F.xxhash64("s.value", "s.start"), F.length("text")).cast("int") + 1, F.lit(AROUND)), F.lit(" "))
    each = each.select("doc_id", "s.kind", near.alias("near"), far.alias("far"), F.explode(hidden_forms(F.col("s"))).alias("f"))
    put = F.when(F.col("f.label") == 1.0, F.array("near", "far")).otherwise(F.array("far"))
    each = each.select("doc_id", "kind", "f.value", "f.label", F.explode(put).alias("before"))
    begin = F.length("before")
    kind = F.when(F.col("kind") == "email", "email").otherwise("number")
    span = F.struct(kind.alias("kind"), begin.alias("start"), (begin + F.length("value")).alias("end"), F.col("value"))
    held = F.substring(order, 32, 1).isin(*"89abcdef")
    return each.select("doc_id", features(spans.pieces(F.concat("before", "value", F.lit(" "))), span).alias("x"), "label", held.alias("held_out"))


def fit(docs: DataFrame, most: int = SAMPLE_DOCS) -> Model:
    """Fit the trees on half of the sample's candidates and calibrate the margin on the other."""
    # Alike candidates are one weighted row: the table stays small and its order is fixed.
    counted = labelled(docs, most).groupBy("x", "label", "held_out").agg(F.count("*").cast("double").alias("weight"))
    rows = counted.select(array_to_vector("x").alias("features"), "x", "label", "weight", "held_out").orderBy("x", "label").coalesce(1).persist()
    try:
        kinds = {(r["held_out"], r["label"]) for r in rows.select("held_out", "label").distinct().collect()}  # four rows at most
        if not {(False, 0.0), (False, 1.0), (True, 1.0)} <= kinds:
            return Model([], math.inf)
        fitted = GBTClassifier(weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(rows.where("NOT held_out"))
        trees = [(w, parse_tree(t.toDebugString)) for w, t in zip(fitted.treeWeights, fitted.trees, strict=True)]
        return Model(trees, calibrate(rows.where("held_out").select(Model(trees, 0).score(F.col("x")).alias("score"), "label", "weight")))
    finally:
        rows.unpersist()


def calibrate(scored: DataFrame, precision: float = PRECISION) -> float:
    """The lowest margin at and above which at least such a share of the weight has label 1."""
    each = scored.groupBy(F.round("score", 6).alias("score")).agg(F.sum(F.col("label") * F.col("weight")).alias("hits"), F.sum("weight").alias("n"))
    sums = each.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "hits", "n"))).alias("x"))  # as many as the trees' leaves combine to
    begin = F.struct(F.lit(0.0).alias("hits"), F.lit(0.0).alias("n"), F.lit(math.inf).alias("best"))

    def step(a: Column, r: Column) -> Column:
        hits, n = a["hits"] + r["hits"], a["n"] + r["n"]
        return F.struct(hits.alias("hits"), n.alias("n"), F.when(hits >= n * precision, -r["low"]).otherwise(a["best"]).alias("best"))

    return sums.select(F.aggregate("x", begin, step, lambda a: a["best"])).first()[0] - 1e-6


def found_spans(text: Column, model: Model) -> Column:
    """A struct of ``base`` spans and ``added`` ones: picked candidates that no base span touches."""
    picked = lambda some: let(spans.pieces(text), lambda cut: F.filter(some, lambda s: model.picks(cut, s)))
    free = lambda base: let(spans.untouched(loose_spans(text), base), lambda some: F.when(F.size(some) > 0, picked(some)).otherwise(some))
    return let(base_spans(text), lambda b: F.struct(b.alias("base"), free(b).alias("added")))


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Each document's spans: doc_id, base, added."""
    model = model or fit(docs)
    return docs.select("doc_id", found_spans(F.coalesce("text", F.lit("")), model).alias("f")).select("doc_id", "f.base", "f.added")


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns of the documents, with each span of the text replaced by its kind in brackets; null text stays null."""
    model = model or fit(docs)
    text = F.col("text")
    mark = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    clean = let(found_spans(text, model), lambda f: spans.replaced(text, F.concat(f["base"], f["added"]), mark))
    return docs.withColumn("text", F.when(text.isNotNull(), clean))


def digests(detected: DataFrame) -> DataFrame:
    """The counts and joined spans of ``detect``."""
    everything = spans.ordered(F.concat("base", "added"), [*KINDS, "number"], True)
    return detected.select(
        "doc_id",
        *[spans.count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"),
        spans.joined(everything).alias("spans"),
    )
