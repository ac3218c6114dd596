"""Secret scans: base patterns, and owner-specific tokens told from widely copied examples.

Method: corpus-wide ownership frequency. Every candidate value (those of the base
patterns and long mixed tokens) is hashed; hashes are aggregated over the corpus
by distinct repositories and distinct owners. A value that ``EXAMPLE_OWNERS``
owners or ``EXAMPLE_REPOSITORIES`` repositories have is a widely copied example.
Any other value is specific to its owners, and live if it looks so: if its
characters vary as in a random string (see ``varied``); else it is a dull
placeholder. The method adds the spans of live tokens (kind ``token``) where no
base span lies, and says of the base spans how many are live, examples and dull.

Null text is empty. Null owners and repositories count as one more of each.
Rows that repeat an id with the same text get the same spans. Only candidates
are shuffled, never texts; a value that a third of the rows hold is counted by
partial aggregation. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm import spans
from affinity.llm.common import let, materialize

# Fixed values of the contract: what introduces a value, and the least lengths.
NAMES = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = "(?:" + "|".join(map(spans.any_case, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "token"]
VALUE_LENGTH = 8
#: A further candidate: a run of token characters with so many digits and letters.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+"
TOKEN_DIGITS, TOKEN_LETTERS = 4, 4
#: From so many distinct owners, or repositories of whichever owners, on, a value is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6
#: Equally frequent characters to which the value's own are worth: the inverse of the chance that two places of it agree.
WORTH = 8
#: Parts into which each value's rows are dealt for the join with its frequency.
PARTS = 16


def base_spans(text: Column) -> Column:
    """The base spans by start, then kind. The value of ``assign`` is what is assigned."""
    value = lambda s: F.regexp_extract(s["value"], ASSIGN, 1)
    assigned = F.filter(spans.matches(text, ASSIGN, "assign"), lambda s: F.length(value(s)) >= VALUE_LENGTH)
    assigned = F.transform(assigned, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value(s).alias("value")))
    return spans.ordered(F.concat(assigned, spans.matches(text, ACCESS, "access"), spans.matches(text, HEX, "hex")), KINDS, False)


def token_spans(text: Column) -> Column:
    """Spans of long tokens with letters and digits."""
    count = lambda s, x: F.regexp_count(s["value"], F.lit(x))
    return F.filter(spans.matches(text, TOKEN, "token"), lambda s: (count(s, "[0-9]") >= TOKEN_DIGITS) & (count(s, "[A-Za-z]") >= TOKEN_LETTERS))


def varied(value: Column) -> Column:
    """Whether the characters of a value are worth ``WORTH`` equally frequent ones at least (collision entropy, in whole numbers)."""

    def worth(chars: Column) -> Column:
        times = lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("long")
        squares = F.aggregate(F.transform(F.array_distinct(chars), times), F.lit(0).cast("long"), lambda a, n: a + n * n)
        return F.size(chars).cast("long") * F.size(chars) >= squares * WORTH

    return let(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), worth)


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Each document's base and added spans: doc_id, base, added, n_live, n_example, n_dull.

    ``owner`` and ``repository`` name the columns that tell owners and repositories apart.
    """
    text = F.coalesce("text", F.lit(""))
    own = F.coalesce(F.col(owner).cast("string"), F.lit(""))
    where = F.to_json(F.struct(*repository))
    found = let(base_spans(text), lambda b: F.struct(b.alias("base"), spans.untouched(token_spans(text), b).alias("more")))
    read = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), own.alias("owner"), where.alias("repository"), found.alias("f"))
    read = materialize(read.select("doc_id", "text_hash", "owner", "repository", F.col("f.base").alias("base"), F.col("f.more").alias("more")))
    each = read.where("size(base) + size(more) > 0").select("doc_id", "text_hash", "owner", "repository", F.explode(F.concat("base", "more")).alias("s"))
    each = each.withColumn("hash", F.md5(F.col("s.value").cast("binary"))).withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(PARTS)))
    told = _told(each.join(verdicts(each), ["hash", "part"]))
    same = F.col("doc_id").eqNullSafe(F.col("told_id")) & (F.col("text_hash") == F.col("told_hash"))
    size = lambda x: F.when(F.col("told_hash").isNull(), 0).otherwise(F.size(x)).cast("long")
    return read.join(told, same, "left").select(
        "doc_id", "base", F.coalesce("added", spans.none()).alias("added"), *[size(k).alias(f"n_{k}") for k in ("live", "example", "dull")]
    )


def verdicts(each: DataFrame) -> DataFrame:
    """What each value is (``live``, ``example`` or ``dull``), once for every part its rows are dealt into: hash, part, verdict."""
    by_place = each.groupBy("hash", "owner", "repository").agg(F.first("s.value").alias("value"))
    by_owner = by_place.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.first("value").alias("value"))
    frequency = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.first("value").alias("value"))
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    verdict = F.when(copied, "example").when(varied(F.col("value")), "live").otherwise("dull")
    return frequency.select("hash", verdict.alias("verdict"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))


def _told(judged: DataFrame) -> DataFrame:
    """For each document the added spans, and its base spans by verdict."""
    token = F.col("s.kind") == "token"
    of = lambda verdict: F.collect_set(F.when(~token & (F.col("verdict") == verdict), F.col("s"))).alias(verdict)
    told = judged.groupBy("doc_id", "text_hash").agg(F.collect_set(F.when(token & (F.col("verdict") == "live"), F.col("s"))).alias("added"), *map(of, ("live", "example", "dull")))
    return told.withColumnsRenamed({"doc_id": "told_id", "text_hash": "told_hash"})


def digests(scanned: DataFrame) -> DataFrame:
    """The counts and joined spans of ``scan``."""
    everything = spans.ordered(F.concat("base", "added"), KINDS, False)
    return scanned.select(
        "doc_id",
        *[spans.count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"),
        spans.joined(everything).alias("spans"),
        "n_live",
        "n_example",
        "n_dull",
    )


def scan_sql() -> str:
    """DuckDB SQL of ``digests(scan(documents))``."""
    token = "[A-Za-z0-9+/_-]+"

    def found(kind: str, pattern: str, keep: str, value: str = "x") -> str:
        gaps = f"regexp_split_to_array(text, '{pattern}')"
        return (
            f"SELECT r, doc_id, source, lang, '{kind}' AS kind, {KINDS.index(kind)} AS k, (before + length(gap))::INTEGER AS a, "
            f"(before + length(gap) + length(x))::INTEGER AS b, {value} AS v FROM (SELECT r, doc_id, source, lang, x, gap, "
            "coalesce(sum(length(gap) + length(x)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before "
            f"FROM (SELECT r, doc_id, source, lang, unnest(m) AS x, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM "
            f"(SELECT *, regexp_extract_all(text, '{pattern}') AS m, {gaps} AS g FROM d))) WHERE {keep}"
        )

    assign = ASSIGN.replace("'", "''")
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS text FROM documents),
base AS ({found("assign", assign, f"length(regexp_extract(x, '{assign}', 1)) >= {VALUE_LENGTH}", f"regexp_extract(x, '{assign}', 1)")}
UNION ALL {found("access", ACCESS, "true")}
UNION ALL {found("hex", HEX, "true")}),
tokens AS ({found("token", token, f"length(x) >= 24 AND length(regexp_replace(x, '[^0-9]', '', 'g')) >= {TOKEN_DIGITS} AND length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= {TOKEN_LETTERS}")}),
every AS (SELECT * FROM base UNION ALL SELECT * FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = t.r AND b.a < t.b AND t.a < b.b)),
places AS (SELECT v, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT (source, lang)) AS repositories FROM every GROUP BY v),
letters AS (SELECT v, owners, repositories, string_split(v, '') AS c FROM places),
judged AS (SELECT v, CASE WHEN owners >= {EXAMPLE_OWNERS} OR repositories >= {EXAMPLE_REPOSITORIES} THEN 'example'
    WHEN len(c) * len(c) >= {WORTH} * list_sum(list_transform(list_distinct(c), lambda x: len(list_filter(c, lambda y: y = x)) * len(list_filter(c, lambda y: y = x)))) THEN 'live' ELSE 'dull' END AS verdict FROM letters),
told AS (SELECT e.*, verdict FROM every e JOIN judged USING (v)),
sums AS (SELECT r, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3) AS base,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3 OR verdict = 'live') AS spans,
    count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k < 3 AND verdict = 'live') AS n_live,
    count(*) FILTER (k < 3 AND verdict = 'example') AS n_example, count(*) FILTER (k < 3 AND verdict = 'dull') AS n_dull FROM told GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_dull, 0) AS n_dull FROM d LEFT JOIN sums USING (r)"""
