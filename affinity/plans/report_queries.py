"""Queries behind reports, edits of texts, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.functions import text, vectors
from affinity.operators import identity, layers, report
from affinity.plans.graph_queries import CO_SQL, PLAYS_SQL, plays, strong
from affinity.plans.registry import Registry, table
from affinity.sources import files

REGISTRY = Registry()


@REGISTRY.add(f"""WITH {PLAYS_SQL}, s AS (SELECT genre, sum(seconds)::BIGINT AS v FROM plays GROUP BY genre),
r AS (SELECT row_number() OVER (ORDER BY v DESC, genre) + 2 AS pos, '| ' || genre || ' | ' || CASE WHEN v >= 3600 THEN printf('%.1f', v / 3600.0::DOUBLE) || ' hrs' ELSE round_even(v / 60, 0)::BIGINT || ' min' END
    || ' | ' || printf('%.1f', v * 100.0::DOUBLE / sum(v) OVER ()) || '% |' AS line FROM s)
SELECT 1::BIGINT AS pos, '| Genre | Played | Share |' AS line UNION ALL SELECT 2, '|---|---|---|' UNION ALL SELECT * FROM r""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a table of shares."""
    totals = plays(spark, sf_dir).groupBy("genre").agg(F.sum("seconds").alias("seconds"))
    return report.with_header(report.share_lines(totals, "genre", "seconds"), "| Genre | Played | Share |", "|---|---|---|")


@REGISTRY.add("""SELECT p_partkey, '---' || chr(10) || 'name: ' || p_name || chr(10) || 'meta_genres: [' || p_type || ', x]' || chr(10) || '---' || chr(10) || 'Body of ' || p_brand || ' --- meta_genres: kept' AS note FROM part""")
def frontmatter_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes whose front matter gets new lists and keeps its body."""
    old = F.concat(F.lit("---\nname: "), F.col("p_name"), F.lit("\nmeta_genres: [old]\nlastfm_tags: [gone]\n---\nBody of "), F.col("p_brand"), F.lit(" --- meta_genres: kept"))
    lists = {"meta_genres": F.array("p_type", F.lit("x")), "lastfm_tags": F.array().cast("array<string>")}
    return table(spark, sf_dir, "part").select("p_partkey", report.front_matter_upserted(old, lists).alias("note"))


@REGISTRY.add("""SELECT p_partkey, 'Intro ' || p_name || chr(10) || chr(10) || '## Frontier' || chr(10) || chr(10) || '- ' || p_brand || chr(10) AS note FROM part""")
def section_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose last section is replaced or appended."""
    old = F.concat(F.lit("Intro "), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "\n\n## Frontier\n\n- old\n- older\n").otherwise("\n"))
    return table(spark, sf_dir, "part").select("p_partkey", report.section_upserted(old, "Frontier", F.concat(F.lit("- "), F.col("p_brand"))).alias("note"))


@REGISTRY.add("""WITH f AS (SELECT l_partkey AS uri, max(l_shipdate)::VARCHAR AS seen FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey),
o AS (SELECT p_partkey AS uri, p_name AS name, p_size::BIGINT AS s FROM part WHERE p_size > 10)
SELECT f.uri, coalesce(o.name, 'new') AS name, coalesce(o.s, 0) AS played_seconds, CASE WHEN f.uri % 2 = 0 THEN seen ELSE CASE WHEN o.uri IS NOT NULL THEN 'old' END END AS last_played_at FROM f LEFT JOIN o USING (uri)""")
def merge_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched items merged with known ones: known metadata stays, missing times stay, unfetched items go."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("uri")).agg(F.date_format(F.max("l_shipdate"), "yyyy-MM-dd HH:mm:ss").alias("at"))
    fetched = lines.select("uri", F.lit("new").alias("name"), F.when(F.col("uri") % 2 == 0, F.col("at")).alias("last_played_at"))
    known = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("uri"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("played_seconds"), F.lit("old").alias("last_played_at"))
    return files.refreshed(fetched, known)


@REGISTRY.add(f"""WITH {CO_SQL} SELECT 'edges' AS what, CASE WHEN weight >= 3 THEN 'close' ELSE 'loose' END AS name, count(*) AS n FROM strong GROUP BY ALL
UNION ALL SELECT 'nodes', p_type, count(*) FROM part GROUP BY p_type""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of nodes by kind and edges by type."""
    from affinity.operators import metrics

    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("kind"))
    return metrics.summary(nodes, strong(spark, sf_dir).withColumn("type", F.when(F.col("weight") >= 3, "close").otherwise("loose")))


@REGISTRY.add("""SELECT p_partkey::VARCHAR AS node, p_name AS name, 'a, ' || p_brand AS tags, '' AS missing FROM part""")
def flat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as an export takes them: lists joined, nulls empty."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.array(F.lit("a"), "p_brand").alias("tags"), F.lit(None).cast("int").alias("missing"))
    return files.flat(nodes)


@REGISTRY.add("""SELECT '<tr><td>' || page_id || '</td><td>' || replace(replace(html, '<', '&lt;'), '>', '&gt;') || '</td></tr>' AS line FROM pages""")
def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an HTML table with escaped cells."""
    return report.html_table(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")


@REGISTRY.add(f"""WITH {PLAYS_SQL}, s AS (SELECT genre, brand, sum(seconds)::BIGINT AS v FROM plays GROUP BY ALL),
r AS (SELECT genre, brand, sum(v)::BIGINT AS v FROM s GROUP BY ROLLUP (genre, brand))
SELECT genre, (brand IS NOT NULL)::INTEGER AS level, v AS seconds, CASE WHEN brand IS NULL THEN '## ' || genre ELSE '- ' || brand END || ' (' ||
    CASE WHEN v >= 3600 THEN printf('%.1f', v / 3600.0::DOUBLE) || ' hrs' ELSE round_even(v / 60, 0)::BIGINT || ' min' END || ')' AS line FROM r WHERE genre IS NOT NULL""")
def tree_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a two-level tree."""
    return report.tree_lines(layers.rolled_up(plays(spark, sf_dir), "genre", "brand", "seconds"), "genre", "brand", "seconds")


@REGISTRY.add("""SELECT s_suppkey, 8 + 32.0::DOUBLE * abs(s_acctbal) / (SELECT max(abs(s_acctbal)) FROM supplier) AS size, CASE s_nationkey % 3 WHEN 0 THEN '#F03E3E' WHEN 1 THEN '#37B24D' ELSE '#888' END AS colour, s_name AS file FROM supplier""")
def node_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display sizes and colours."""
    own = table(spark, sf_dir, "supplier")
    top = own.agg(F.max(F.abs("s_acctbal")).alias("top")).scalar()
    kind = F.when(F.col("s_nationkey") % 3 == 0, "influence").when(F.col("s_nationkey") % 3 == 1, "similarity").otherwise("other")
    return own.select("s_suppkey", vectors.linear_size(F.abs("s_acctbal"), top, 8.0, 32.0).alias("size"), report.edge_style(kind, F.lit("curated")).alias("colour"), text.file_name(F.col("s_name")).alias("file"))


@REGISTRY.add("""SELECT CASE WHEN p_size > 25 THEN 0 ELSE 1 END AS part, '- [[' || p_name || ']] → [[' || p_brand || ']]' || CASE WHEN p_type <> 'LARGE' THEN ' — ' || p_type ELSE '' END AS line FROM part""")
def lineage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of influence edges, curated first."""
    edges = table(spark, sf_dir, "part").select(F.col("p_name").alias("src"), F.col("p_brand").alias("dst"), F.when(F.col("p_size") > 25, "curated").otherwise("llm").alias("source"), F.when(F.col("p_type") != "LARGE", F.col("p_type")).alias("note"))
    return report.lineage_lines(edges)


@REGISTRY.add("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def incomplete_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that an enrichment run would fetch: those without labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.array("quality").alias("found"))
    cache = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return identity.incomplete(cache, "found").select("doc_id")
