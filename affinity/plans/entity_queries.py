"""Queries over entity deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.functions import text
from affinity.operators import dedupe
from affinity.plans.registry import Registry, table

REGISTRY = Registry()

# Spellings of the parts' names: capitals, an apostrophe, stops, an ampersand, by part.
SPELT_SQL = """spelt AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', '''e') WHEN 2 THEN replace(p_name, ' ', ' & ') WHEN 3 THEN replace(p_name, ' ', ', ') ELSE replace(p_name, ' ', '. ') END AS name,
    p_name AS origin FROM part)"""
LOOSE_SQL = "replace(replace(lower(name), '''', ''), ' & ', ', ')"
TAGS_SQL = f"""{SPELT_SQL},
entities AS (SELECT name, list_sort(list(DISTINCT tag)) AS tags, min(depth) AS depth FROM (SELECT s.name, p.p_brand || CASE WHEN (length(s.name) + p.p_size) % 3 = 0 THEN ' (' || length(s.name) || ')' ELSE '' END AS tag, p.p_size AS depth FROM spelt s JOIN part p ON p.p_name = s.origin) GROUP BY name),
indegree AS (SELECT name, length(name) % 7 AS d FROM entities WHERE length(name) % 7 > 0),
keyed AS (SELECT e.*, {LOOSE_SQL} AS key, coalesce(d, 0) AS d FROM entities e LEFT JOIN indegree USING (name)),
winners AS (SELECT key, arg_min(name, (-d, name = upper(name) AND name <> lower(name), name)) AS winner FROM keyed GROUP BY key HAVING count(*) > 1),
picks AS (SELECT key, name, winner FROM keyed JOIN winners USING (key))"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings with tags and a depth: name, tags, depth."""
    part = table(spark, sf_dir, "part")
    name = F.expr("""CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', '\\'e') WHEN 2 THEN replace(p_name, ' ', ' & ') WHEN 3 THEN replace(p_name, ' ', ', ') ELSE replace(p_name, ' ', '. ') END""")
    spelt = part.select(name.alias("name"), F.col("p_name").alias("origin")).distinct()
    both = spelt.join(part, F.col("p_name") == F.col("origin"))
    # A third of a spelling's tags are its own, so that spellings differ in tags.
    own = F.when((F.length("name") + F.col("p_size")) % 3 == 0, F.concat(F.lit(" ("), F.length("name").cast("string"), F.lit(")"))).otherwise("")
    both = both.withColumn("tag", F.concat("p_brand", own))
    return both.groupBy("name").agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.min("p_size").alias("depth"))


def in_degree(own: DataFrame) -> DataFrame:
    """A made-up in-degree of each name."""
    return own.select(F.col("name").alias("node"), (F.length("name") % 7).alias("in_degree")).where("in_degree > 0")


def picks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The entities and their canonical picks."""
    own = entities(spark, sf_dir)
    return own, dedupe.canonical(own, text.loose_key(F.col("name")), in_degree(own))


@REGISTRY.add(f"""WITH {TAGS_SQL} SELECT key, list_sort(list(DISTINCT name)) AS names FROM keyed GROUP BY key HAVING count(DISTINCT name) > 1""")
def loose_key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that one loose key joins."""
    return dedupe.groups(entities(spark, sf_dir), text.loose_key(F.col("name")))


@REGISTRY.add(f"""WITH {TAGS_SQL} SELECT key, name, winner FROM picks""")
def canonical_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical name of each group."""
    return picks(spark, sf_dir)[1]


@REGISTRY.add(f"""WITH {TAGS_SQL}, r AS (SELECT e.*, coalesce(p.winner, e.name) AS w FROM entities e LEFT JOIN picks p USING (name)),
t AS (SELECT w, tag, min((name <> w, name, i)) AS o FROM (SELECT w, name, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM r) GROUP BY ALL)
SELECT w AS name, list(tag ORDER BY o) AS tags, any_value(depth) AS depth FROM t JOIN (SELECT w, min(depth) AS depth FROM r GROUP BY w) USING (w) GROUP BY w""")
def merge_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each group: tags in order, least depth."""
    own, chosen = picks(spark, sf_dir)
    return dedupe.merged(own, dedupe.renames(chosen))


@REGISTRY.add(f"""WITH {TAGS_SQL}, g AS (SELECT p.name, p.winner, len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags))) AS jaccard
    FROM picks p JOIN entities a ON a.name = p.name JOIN entities b ON b.name = p.winner WHERE p.name <> p.winner)
SELECT name, winner, jaccard, jaccard >= 0.25 AS merge FROM g""")
def jaccard_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pairs have enough shared tags to merge."""
    own, chosen = picks(spark, sf_dir)
    return dedupe.gated(own, chosen)




def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of names (but one), and whole names as comma-separated compounds."""
    part = table(spark, sf_dir, "part")
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k)).alias("name")
    return part.select(word(1)).union(part.where("NOT contains(p_name, 'gizmo')").select(word(2))).union(part.where("p_size > 10").select(F.replace("p_name", F.lit(" "), F.lit(", ")))).distinct()


@REGISTRY.add("""WITH names AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part WHERE NOT contains(p_name, 'gizmo') UNION SELECT DISTINCT replace(p_name, ' ', ', ') FROM part WHERE p_size > 10),
junk AS (SELECT name, list_transform(string_split(name, ','), lambda x: trim(x)) AS parts FROM names WHERE contains(name, ',')),
each AS (SELECT name, parts, unnest(parts) AS part FROM junk)
SELECT e.name, e.parts FROM each e JOIN names n ON n.name = e.part GROUP BY e.name, e.parts HAVING count(*) = len(e.parts)""")
def compound_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds whose parts all are names of their own."""
    return dedupe.compound_junk(compounds(spark, sf_dir))


@REGISTRY.add("""WITH names AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part WHERE NOT contains(p_name, 'gizmo') UNION SELECT DISTINCT replace(p_name, ' ', ', ') FROM part WHERE p_size > 10),
junk AS (SELECT name, list_transform(string_split(name, ','), lambda x: trim(x)) AS parts FROM names WHERE contains(name, ',')),
each AS (SELECT name, parts, unnest(parts) AS part FROM junk),
bad AS (SELECT e.name, e.parts FROM each e JOIN names n ON n.name = e.part GROUP BY e.name, e.parts HAVING count(*) = len(e.parts)),
refs AS (SELECT a.name AS src, b.name AS dst, (1 + (length(a.name) * 3 + length(b.name)) % 8) / 8.0::DOUBLE AS match FROM names a JOIN names b ON a.name <> b.name AND left(a.name, 2) = left(b.name, 2)),
ren AS (SELECT name, upper(name) AS winner FROM names WHERE NOT contains(name, ',') AND length(name) % 2 = 0),
fan AS (SELECT coalesce(r.winner, src) AS src, match, coalesce(d.winner, dst) AS dst FROM refs LEFT JOIN ren r ON r.name = src LEFT JOIN ren d ON d.name = dst),
o AS (SELECT src, unnest(coalesce(b.parts, [dst])) AS dst, match FROM fan LEFT JOIN bad b ON b.name = dst WHERE src NOT IN (SELECT name FROM bad))
SELECT src, dst, max(match) AS match FROM o WHERE src <> dst GROUP BY src, dst""")
def rewrite_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References after renames and with compounds fanned out."""
    names = compounds(spark, sf_dir)
    a, b = names.select(F.col("name").alias("src"), F.left("name", F.lit(2)).alias("k")), names.select(F.col("name").alias("dst"), F.left("name", F.lit(2)).alias("k"))
    refs = a.join(b, "k").where("src <> dst").select("src", "dst", ((1 + (F.length("src") * 3 + F.length("dst")) % 8) / 8.0).alias("match"))
    renamed = names.where(~F.contains("name", F.lit(",")) & (F.length("name") % 2 == 0)).select("name", F.upper("name").alias("winner"))
    return dedupe.rewritten(refs, renamed, dedupe.compound_junk(names))


@REGISTRY.add("""WITH k AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key FROM documents),
g AS (SELECT key, min(doc_id) AS keeper, count(*) AS copies FROM k GROUP BY key HAVING count(*) > 1)
SELECT md5(key) AS key_md5, keeper, copies FROM g""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are equal but for case and blanks: their keeper and number."""
    key = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.md5(key.cast("binary")).alias("key_md5"))
    return keyed.groupBy("key_md5").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1")
