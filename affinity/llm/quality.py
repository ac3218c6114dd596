"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text.

Method: words and word pairs are hashed into a fixed number of buckets. Two
multinomials over the buckets are counted, one on the trusted target (documents
labelled good and not toxic) and one on the whole raw corpus. A document's score
is the sum of the log ratios of its buckets, divided by their number; every
document whose mean is under a threshold is rejected. Simple base rules
(too short, mostly repeated) come first.

The threshold is ``THRESHOLD`` unless more than a thousandth of the clean labelled
documents would be lost, as in a tiny corpus whose copies weigh much. Then it is
midway between the lowest clean mean (but for that thousandth) and the next
junk mean below it.

Log ratios are rounded to millionths and summed as integers, so the verdict
doesn't depend on the order of work. The corpus and all trusted documents are
counted whole. Every document is scored once, and the threshold is fitted on all
labelled ones.

Null text has no words; texts without words fail the base rules. Repeated rows
and null keys are judged row by row (and every row counts in the raw corpus).
With no trusted documents every ratio is zero. Only DataFrame
functions are used. Shuffled are the texts, to meet the trusted ids, a count for
each bucket and task, and the means of the documents, to meet the labelled ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import BLANK_CLASS, CRC_CTES, CRC_OF_HX, blank_words, let, materialize, row_of

#: Buckets of single words, and as many again of word pairs.
BUCKETS = 4096
#: Weight of the raw distribution in the trusted one, in grams: with few trusted documents ratios shrink to none.
PRIOR = 8192
MICRO = 1_000_000
#: Mean log ratio (millionths) under which a document is rejected: the lowest mean of a clean labelled
#: document (quality 1, not toxic, past the base rules) of the given tables, -48,601, down to the next ten thousand.
THRESHOLD = -50_000
#: Grams of ratio zero that are added to each document: none, as they lift junk over the threshold.
NEUTRAL_GRAMS = 0
#: One in so many clean labelled documents may lie under the threshold.
MAY_LOSE = 1000
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
WEIGHTS = "affinity_log_ratios"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def word_hashes(words: Column) -> Column:
    """The CRC-32 of every word."""
    return F.transform(words, lambda x: F.crc32(x.cast("binary")))


def neighbours(values: Column, apart: int, both) -> Column:
    """``both`` of all values that are so far apart, in order."""
    later = F.slice(values, apart + 1, F.greatest(F.size(values), F.lit(1)))
    return F.slice(F.zip_with(values, later, both), 1, F.greatest(F.size(values) - apart, F.lit(0)))


def gram_buckets(hashes: Column) -> Column:
    """The buckets of all words, then of all pairs of neighbours."""
    pairs = neighbours(hashes, 1, lambda a, b: ((a * 31 + b) % BUCKETS + BUCKETS).cast("int"))
    return F.concat(F.transform(hashes, lambda x: (x % BUCKETS).cast("int")), pairs)


def repeated_words(words: Column, hashes: Column) -> Column:
    """How many words lie in a window of 8 words that the text has twice or more."""

    def exact(w: Column, n: Column) -> Column:
        windows = F.array_sort(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("x"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, other: F.coalesce(x["x"] == other["x"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"]))

        def covered(p: Column) -> Column:
            each = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(windows, twice), covered)

    # Without two equal hashes of windows there is no repeat; only other texts are looked at closely.
    n = F.size(words) - (WINDOW - 1)
    windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    some = let(windows, lambda x: F.size(F.array_distinct(x)) < F.size(x))
    return F.when(n < 2, F.lit(0).cast("long")).when(some, exact(words, n)).otherwise(F.lit(0).cast("long"))


def repeated_lines(text: Column) -> Column:
    """How many lines with a word equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def log_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with the array ``weights``: each bucket's log ratio, trusted over raw, in millionths.

    The texts meet all trusted ids by a shuffle; those without an id are dealt by their hash.
    """
    trusted = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id", F.lit(0).cast("long").alias("part"), F.lit(1).alias("trusted")).distinct()
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("part"))
    rows = rows.join(trusted.hint("shuffle_hash"), ["doc_id", "part"], "left")
    grams = rows.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(let(word_hashes(blank_words(F.col("text"))), gram_buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    every = docs.sparkSession.range(2 * BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counts), "bucket", "left")  # 2 * BUCKETS rows
    t, r = F.coalesce("target", F.lit(0)), F.coalesce("raw", F.lit(0))
    whole = lambda c: F.sum(c).cast("double")
    listed = every.agg(F.array_sort(F.collect_list(F.struct("bucket", t.alias("t"), r.alias("r")))).alias("x"), whole(t).alias("all_t"), whole(r).alias("all_r"))
    share = lambda x: x["r"] / F.col("all_r")
    ratio = lambda x: F.log((x["t"] + PRIOR * share(x)) / ((F.col("all_t") + PRIOR) * share(x)))
    micro = lambda x: F.when(x["r"] > 0, F.floor(ratio(x) * MICRO + 0.5)).otherwise(0).cast("long")
    return listed.select(F.transform("x", micro).alias("weights"))


def fit_threshold(scored: DataFrame, labels: DataFrame) -> int:
    """The threshold by all labelled documents; ``scored`` has doc_id, base_failed, n_grams and llr_micro of every document."""
    clean = F.when(F.expr("quality = 1 AND toxic = 0"), True).when(F.col("quality") == 0, False)
    ids = labels.where("doc_id IS NOT NULL").select("doc_id", clean.alias("clean")).where("clean IS NOT NULL").distinct()
    rows = scored.where("NOT base_failed").select("doc_id", (F.col("llr_micro") / (F.col("n_grams") + NEUTRAL_GRAMS)).alias("mean"))
    means = materialize(rows.join(ids, "doc_id").select("clean", "mean"))
    clean = means.where("clean")
    low = clean.orderBy("mean").offset(clean.count() // MAY_LOSE).limit(1).first()
    if low is None or low["mean"] >= THRESHOLD:
        return THRESHOLD
    below = means.where(~F.col("clean") & (F.col("mean") < low["mean"])).agg(F.max("mean")).first()[0]
    return math.floor(low["mean"] if below is None else (low["mean"] + below) / 2)


def passes(base_failed: Column, n_grams: Column, llr_micro: Column, threshold: int) -> Column:
    """Whether a scored document is kept."""
    return ~base_failed & (llr_micro >= (n_grams + NEUTRAL_GRAMS) * threshold)


def judge(docs: DataFrame, labels: DataFrame, threshold: int | None = None) -> DataFrame:
    """All columns of ``docs`` that matter here, with the base counts, the score and the verdict.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_grams and llr_micro (the summed log ratios).
    """
    weights = materialize(log_ratios(docs, labels))
    rows = docs.select("doc_id", "text", weights.scalar().alias(WEIGHTS))
    scored = rows.select("doc_id", _scores(F.col("text"), F.col(WEIGHTS)).alias("v")).select("doc_id", "v.*")
    if threshold is None:
        scored = materialize(scored)
        threshold = fit_threshold(scored, labels)
    kept = passes(F.col("base_failed"), F.col("n_grams"), F.col("llr_micro"), threshold).alias("kept")
    return scored.select("doc_id", *BASE, "base_failed", kept, "n_grams", "llr_micro")


def keep(docs: DataFrame, labels: DataFrame, threshold: int | None = None) -> DataFrame:
    """The documents that pass, with all their columns."""
    weights = materialize(log_ratios(docs, labels))
    rows = docs.select(row_of(docs).alias("doc"), "text", weights.scalar().alias(WEIGHTS))
    rows = rows.select("doc", _scores(F.col("text"), F.col(WEIGHTS)).alias("v")).select("doc", "v.base_failed", "v.n_grams", "v.llr_micro")
    # Written with the texts: to read them again costs less than to score them again, as a filter below the scores would, too.
    rows = materialize(rows)
    if threshold is None:
        threshold = fit_threshold(rows.select("doc.doc_id", "base_failed", "n_grams", "llr_micro"), labels)
    return rows.where(passes(F.col("base_failed"), F.col("n_grams"), F.col("llr_micro"), threshold)).select("doc.*")


def _scores(text: Column, weights: Column) -> Column:
    """The counts and the score of one text, as a struct."""
    text = F.coalesce(text, F.lit(""))
    long = lambda x: x.cast("long")

    def counts(w: Column, h: Column) -> Column:
        return F.struct(
            long(F.size(w)).alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            long(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
            repeated_lines(text).alias("n_dup_lines"),
            repeated_words(w, h).alias("n_repeat_words"),
            let(gram_buckets(h), lambda g: F.struct(long(F.size(g)).alias("n"), _summed(g, weights).alias("s"))).alias("g"),
        )

    def judged(c: Column) -> Column:
        failed = (c["n_words"] < MIN_WORDS) | (c["n_repeat_words"] * 100 > c["n_words"] * MAX_REPEAT_PERCENT)
        return F.struct(*[c[n].alias(n) for n in BASE], failed.alias("base_failed"), c["g"]["n"].alias("n_grams"), c["g"]["s"].alias("llr_micro"))

    return let(let(blank_words(text), lambda w: let(word_hashes(w), lambda h: counts(w, h))), judged)


def _summed(buckets: Column, weights: Column) -> Column:
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda a, b: a + F.element_at(weights, b + 1))


def judge_sql(threshold: int = THRESHOLD) -> str:
    """DuckDB SQL of ``judge`` over ``documents`` and ``labels``."""
    word = rf"[^\x20\x09-\x0D]+"
    return rf"""WITH RECURSIVE {CRC_CTES},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, doc_id, text, regexp_extract_all(text, '{word}') AS w FROM d),
spots AS (SELECT r, doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM words),
hexed AS (SELECT DISTINCT x, hex(encode(x)) AS hx FROM spots),
hashed AS (SELECT x, {CRC_OF_HX} AS h FROM hexed, crc_table),
h AS (SELECT s.r, s.doc_id, s.i, s.n, h.h FROM spots s JOIN hashed h USING (x)),
grams AS (
    SELECT r, doc_id, h % {BUCKETS} AS b FROM h
    UNION ALL
    SELECT a.r, a.doc_id, (a.h * 31 + c.h) % {BUCKETS} + {BUCKETS} FROM h a JOIN h c ON c.r = a.r AND c.i = a.i + 1),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
counted AS (SELECT k.b, count(g.b) AS c, count(t.doc_id) AS t FROM range({2 * BUCKETS}) k(b) LEFT JOIN grams g ON g.b = k.b LEFT JOIN trusted t ON t.doc_id = g.doc_id GROUP BY k.b),
shares AS (SELECT b, c, t, c / sum(c) OVER ()::DOUBLE AS share, sum(t) OVER ()::DOUBLE AS all_t FROM counted),
weights AS (SELECT b, CASE WHEN c > 0 THEN floor(ln((t + {PRIOR} * share) / ((all_t + {PRIOR}) * share)) * {MICRO} + 0.5)::BIGINT ELSE 0 END AS weight FROM shares),
scores AS (SELECT r, count(*) AS n_grams, sum(weight)::BIGINT AS llr FROM grams JOIN weights USING (b) GROUP BY r),
windows AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
covered AS (SELECT r, sum(least({WINDOW}, coalesce(after - i, {WINDOW})))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM twice) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (
    SELECT r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{BLANK_CLASS}+', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        coalesce(s.n_grams, 0)::BIGINT AS n_grams, coalesce(s.llr, 0)::BIGINT AS llr_micro
    FROM words LEFT JOIN lines l USING (r) LEFT JOIN covered c USING (r) LEFT JOIN scores s USING (r)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND llr_micro >= (n_grams + {NEUTRAL_GRAMS}) * ({threshold}) AS kept, n_grams, llr_micro
FROM judged"""
