"""How the sources of a language differ in their words: smoothed term shares, chi-square contributions.

The terms of a text are its runs of letters (all code points from 128 on count as
letters), only A-Z lower-cased. Each task counts its texts' terms, occurrences and
documents, by language and source; one shuffle brings the counts of a term
together. They are then one row: an array over the language's sources, zero where
it doesn't occur. Higher-order functions turn each row into the sources' shares,
and from these each pair of sources gets the term's contribution, which partial
aggregation sums where it arises: a shuffle has one row for each pair and task.

A term that fills a third of all texts is a few partial rows; a source that holds
a third of all rows is one place of the arrays. Arrays are as long as a language
has sources, and the result has their square, as each pair is asked for. The
language's heads (sources, counts) meet its terms by a shuffle dealt into
``SALTS`` parts unless their measured size lets adaptive execution broadcast them.

All arithmetic is in integers. Null texts, languages and sources are read as
empty. Every row counts as a document of its own, also if it repeats an id or a
text. A language whose terms all occur in fewer than ``LEAST_DOCS`` rows has no
kept term: its pairs have the value 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinity.llm.common import materialize

LEAST_DOCS, SCALE, MOST_TERMS = 3, 1_000_000_000, 200
#: Parts into which a language's terms are dealt to meet its heads.
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What becomes of each byte: A to Z are lower-cased, other bytes under 128 but a to z are spaces.
LETTERS = bytes(c if c >= 128 or chr(c) in LOWER else c + 32 if chr(c) in UPPER else 32 for c in range(256))
#: Bytes of a text that are cut into terms at once, and counts that a task holds at most before it gives them out.
PIECE_BYTES, MOST_HELD = 4 << 20, 400_000


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, as UTF-8, a long text's in several lists."""
    data = text.encode().translate(LETTERS)
    begin = 0
    while begin < len(data):
        end = data.find(b" ", begin + PIECE_BYTES) if len(data) > begin + PIECE_BYTES else -1
        end = len(data) if end < 0 else end
        yield data[begin:end].split(b" ")
        begin = end + 1


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents); rows of one term are in one partition.

    A task counts its texts by language and source as long as it holds fewer than
    ``MOST_HELD`` counts, then gives them out, so they are combined before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                del n[b""], d[b""]
                words = list(n)
                columns = [pa.array([lang] * len(words), pa.string()), pa.array([source] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n[t] for t in words], pa.int64()), pa.array([d[t] for t in words], pa.int64())], ["lang", "source", "term", "n", "d"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for some in terms(text):
                    n.update(some)
                    own.update(some)
                d.update(own)
            if sum(len(n) for n, _ in held.values()) > MOST_HELD:
                yield from given()
        yield from given()

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    each = read.mapInArrow(run, "lang string, source string, term string, n long, d long")
    return each.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (n + 1) / (total + kept))`` without overflow: three digits at a time."""
    of = total + kept
    whole = lambda x: F.call_function("div", x, of)
    a = (n + 1) * 1000
    b = (a % of) * 1000
    c = (b % of) * 1000
    return whole(a) * 1_000_000 + whole(b) * 1000 + whole(c) + 1


def contribution(p: Column, q: Column) -> Column:
    """``floor((p - q) ** 2 / q)``."""
    return F.call_function("div", (p - q) * (p - q), q)


def by_language(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows with the columns of their language's head; a language's rows are dealt into parts, each with a copy of the head."""
    copies = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(copies, ["lang", "salt"]).drop("salt")


def wide(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """lang, term, counts: one row for each kept term, its occurrences as an array over the language's sources."""
    rows = counts.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("found"), F.sum("d").alias("d")).where(F.col("d") >= LEAST_DOCS)
    known = by_language(rows.withColumn("found", F.map_from_entries("found")), sources)
    zero = F.lit(0).cast("long")
    return known.select("lang", "term", F.transform("sources", lambda s: F.coalesce(F.try_element_at("found", s), zero)).alias("counts"))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: each pair of sources, and each source's over-used terms."""
    sources = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    rows = materialize(wide(counted(docs), sources))
    totals = rows.select("lang", F.posexplode("counts").alias("i", "n")).groupBy("lang", "i").agg(F.sum("n").alias("n"), F.count("*").alias("kept"))
    totals = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("t"), F.max("kept").alias("kept"), F.sum("n").alias("all"))
    heads = materialize(sources.join(totals.select("lang", F.col("t.n").alias("totals"), "kept", "all"), "lang", "left"))
    each = by_language(rows, heads)
    shares = materialize(each.select("lang", "term", "sources", "counts", F.transform("counts", lambda n, i: share(n, F.get("totals", i), F.col("kept"))).alias("shares"), share(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n), F.col("all"), F.col("kept")).alias("q")))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    place = shares.select("lang", "shares", F.posexplode("shares").alias("i", "p"))
    # The contributions are computed as generated code: as a higher-order function they took seven times as long.
    given = place.select("lang", "i", "p", F.posexplode("shares").alias("j", "q")).where("i <> j")
    sums = given.groupBy("lang", "i", "j").agg(F.sum(contribution(F.col("p"), F.col("q"))).alias("value"))
    asked = heads.select("lang", "sources", F.posexplode("sources").alias("i", "source")).select("lang", "i", "source", F.posexplode("sources").alias("j", "item")).where("i <> j")
    pairs = asked.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))

    single = shares.select("lang", "term", "q", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"), F.col("shares").alias("p"))))
    over = single.where("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), contribution(F.col("p"), F.col("q")).alias("value"))
    # Ranks are limited in each task before the shuffle, so that a large source is no large window.
    over = over.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= MOST_TERMS)
    return pairs.unionByName(over)


def audit_sql() -> str:
    """DuckDB SQL for ``audit``."""
    share_sql = lambda n, total: f"({SCALE}::HUGEINT * ({n} + 1) // ({total} + v) + 1)"
    return f"""WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
sources AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
counts AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM sources JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)),
sizes AS (SELECT lang, source, sum(n) AS total, count(*) AS v FROM counts GROUP BY ALL),
p AS (SELECT lang, source, term, n, {share_sql('n', 'total')} AS p FROM counts JOIN sizes USING (lang, source)),
q AS (SELECT lang, term, {share_sql('sum(n)', '(SELECT sum(total) FROM sizes s WHERE s.lang = c.lang)')} AS q
    FROM counts c JOIN (SELECT DISTINCT lang, v FROM sizes) USING (lang) GROUP BY lang, term, v),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
result AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM result QUALIFY part = 'pair' OR rank <= {MOST_TERMS}"""
