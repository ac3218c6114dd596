"""URL filters: host and path rules, and trust spread over the graph of host links.

Method: link-graph propagation. Pages under an allow rule make their host a
trusted seed, pages under a block rule a blocked one (the majority decides).
Personalised PageRank spreads trust from the trusted seeds along links; distrust
spreads from the blocked seeds against links, to those that link to them. A host
is blocked where its distrust exceeds its trust. Links are the ``href`` targets
of pages that name a host (absolute, or with ``//`` and no scheme); besides, a
host links to its parent domain and back, and that to its own parent, up to a
domain of two labels.

After n rounds the ranks differ from their limit by 0.85 to the n-th at most, so
the number of rounds follows from ``PRECISION``; rounds end sooner where nothing
changes. Hosts without links lose their rank; as it would go to the seeds, this is
the same as scaling the ranks of a kind to one at the end.

Ranks are whole numbers (shares of 10^12), so sums don't depend on their order.
A null url, or one without ``://``, has no host and is judged like a host without
links. Repeated rows are judged each; they count again as seeds. All tables of
hosts and links are distributed and pre-aggregated. The fewer than a thousand
hosts with over a thousandth of all pages are joined with these by broadcast, the
others by shuffle; a host of very many links is split by adaptive execution. Only
DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import hot_keys, let, materialize, met

#: (verdict, host, path); a rule fits its host and subdomains where the url's path starts with the rule's.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
MAX_RULES = 1000
UNIT = 10**12
DAMPING = 85
#: What may be missing of a kind's ranks, as a share, and the rounds that this takes.
PRECISION = 0.01
ROUNDS = math.ceil(math.log(PRECISION) / math.log(DAMPING / 100))
#: Rounds after which the ranks are written and compared with what they were.
STRIDE = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""[Hh][Rr][Ee][Ff]\s*=\s*["']?((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark, hash or the end; ASCII letters in lower case."""
    return F.translate(F.regexp_extract(_after(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null. At most ``MAX_RULES`` rules, tested in the row."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, where, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(where + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def links(pages: DataFrame) -> DataFrame:
    """Distinct links between different hosts: a, b."""
    hosts = pages.select("host").where("host <> ''").distinct()
    named = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    stated = pages.where("host <> ''").select(F.col("host").alias("a"), F.explode(F.array_distinct(F.transform(named, lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit(":"), u)).otherwise(u))))).alias("b"))
    parts = F.split("host", r"\.")
    # The chain of a host: itself and every parent domain, each of two labels at least.
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    steps = hosts.select(F.explode(let(chain, lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))).alias("s"))
    upward = steps.select("s.a", "s.b").distinct()
    both = stated.unionByName(upward).unionByName(upward.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where("a <> '' AND b <> '' AND a <> b").distinct()


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank of several kinds at once: kind, host, rank.

    ``seeds`` has (kind, host), ``edges`` (kind, a, b, n) with n the number of links of a kind that leave a.
    """
    count = seeds.groupBy("kind").agg(F.count("*").alias("n"))  # as many rows as kinds
    start = seeds.join(F.broadcast(count), "kind").select("kind", "host", F.expr(f"{UNIT} div n").alias("rank"))
    teleport = materialize(start.select("kind", "host", F.expr(f"rank * {100 - DAMPING} div 100").alias("rank")))
    rank, stamp = materialize(start), None
    for k in range(rounds):
        moved = edges.join(rank.withColumnRenamed("host", "a"), ["kind", "a"])
        moved = moved.select("kind", F.col("b").alias("host"), F.expr(f"rank * {DAMPING} div (100 * n)").alias("rank"))
        rank = teleport.unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if k % STRIDE == STRIDE - 1 or k == rounds - 1:
            rank = materialize(rank)
            before, stamp = stamp, rank.agg(F.count("*"), F.bit_xor(F.xxhash64("kind", "host", "rank"))).first()
            if stamp == before:
                break
    total = rank.groupBy("kind").agg(F.sum("rank").alias("total"))  # as many rows as kinds
    return rank.join(F.broadcast(total), "kind").select("kind", "host", F.expr("rank * 1000000 div greatest(total div 1000000, 1)").alias("rank"))


def judge(pages: DataFrame, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    """Each page's host, path, rule and verdict, with its host's trust and distrust."""
    known = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = known.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    said = known.where("host <> '' AND r IS NOT NULL").groupBy("host").agg(F.sum(F.when(F.col("r.verdict") == "allow", 1).otherwise(-1)).alias("balance"))
    seeds = said.where("balance <> 0").select(F.when(F.col("balance") > 0, "trust").otherwise("distrust").alias("kind"), "host")
    one_way = materialize(links(known))
    edges = one_way.select(F.lit("trust").alias("kind"), "a", "b").unionByName(one_way.select(F.lit("distrust").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b")))
    leaving = edges.groupBy("kind", "a").agg(F.count("*").alias("n"))
    edges = materialize(edges.join(leaving, ["kind", "a"]))
    rank = spread(materialize(seeds), edges, rounds)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0))
    hosts = rank.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))
    pages_of = known.groupBy("host").agg(F.count("*").alias("n"))
    # A row for every host that a page has, so that pages and hosts can be joined inwardly.
    hosts = materialize(pages_of.join(hosts, "host", "left"))
    judged = met(known.select("page_id", "host", "path", "r"), hosts.drop("n"), hot_keys(hosts, "n"), ["host"], F.xxhash64("page_id", "path"))
    own = F.when(F.coalesce("distrust", F.lit(0)) > F.coalesce("trust", F.lit(0)), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), own).alias("verdict"),
        F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"),
    )


def judge_sql(rules=RULES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of ``judge`` over ``pages``."""
    fits = "((host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))"
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    steps = [
        f"""r{i + 1} AS MATERIALIZED (SELECT kind, host, sum(rank)::BIGINT AS rank FROM (
    SELECT kind, host, rank * {100 - DAMPING} // 100 AS rank FROM r0
    UNION ALL SELECT e.kind, e.b, r.rank * {DAMPING} // (100 * e.n) FROM r{i} r JOIN edges e ON e.kind = r.kind AND e.a = r.host) GROUP BY kind, host)"""
        for i in range(rounds)
    ]
    pattern = LINK.replace("'", "''")
    return rf"""WITH u AS (SELECT row_number() OVER () AS i, page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
k AS (SELECT i, page_id, html, translate(regexp_extract(x, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(v, h, p) AS (VALUES {listed}),
fit AS (SELECT i, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM k JOIN rules ON {fits} GROUP BY i),
seeds AS (SELECT host, CASE WHEN sum(CASE verdict WHEN 'allow' THEN 1 ELSE -1 END) > 0 THEN 'trust' ELSE 'distrust' END AS kind
    FROM k JOIN fit USING (i) WHERE host <> '' GROUP BY host HAVING sum(CASE verdict WHEN 'allow' THEN 1 ELSE -1 END) <> 0),
stated AS (SELECT host AS a, unnest(regexp_extract_all(coalesce(html, ''), '{pattern}', 1)) AS url FROM k WHERE host <> ''),
parts AS (SELECT DISTINCT string_split(host, '.') AS h FROM k),
chains AS (SELECT h, unnest(range(1, len(h) - 1)) AS i FROM parts WHERE len(h) > 2),
upward AS (SELECT DISTINCT array_to_string(h[i:], '.') AS a, array_to_string(h[i + 1:], '.') AS b FROM chains),
oneway AS (SELECT DISTINCT a, b FROM (
    SELECT a, translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS b FROM stated
    UNION ALL SELECT a, b FROM upward UNION ALL SELECT b, a FROM upward) WHERE a <> '' AND b <> '' AND a <> b),
edges AS MATERIALIZED (SELECT kind, a, b, count(*) OVER (PARTITION BY kind, a) AS n FROM (SELECT 'trust' AS kind, a, b FROM oneway UNION ALL SELECT 'distrust', b, a FROM oneway)),
r0 AS MATERIALIZED (SELECT kind, host, {UNIT} // count(*) OVER (PARTITION BY kind) AS rank FROM seeds),
{", ".join(steps)},
scaled AS (SELECT kind, host, rank * 1000000 // greatest(sum(rank) OVER (PARTITION BY kind)::BIGINT // 1000000, 1) AS rank FROM r{rounds}),
t AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0)::BIGINT AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0)::BIGINT AS distrust FROM scaled GROUP BY host)
SELECT page_id, k.host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
    coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM k LEFT JOIN fit USING (i) LEFT JOIN t ON t.host = k.host"""
