"""Queries over packed metadata and the identity of tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.functions import text
from affinity.operators import identity
from affinity.plans.registry import Registry, table

REGISTRY = Registry()

# Titles made of part and version words, so that versions collapse.
TITLE_SQL = """CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' - Live' WHEN 2 THEN p_name || ' - Remaster' ELSE p_name || ' - Deluxe Alive' END"""


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a title and a packed name: p_partkey, p_name, title, packed."""
    title = F.expr(TITLE_SQL)
    day = F.concat((F.lit(1960) + F.col("p_size")).cast("string"), F.lit("-01-31"))
    kinds = F.concat(F.lower("p_type"), F.lit(', "rock and roll", and sad'))
    packed = F.concat(
        F.lit("spotify:track:"), F.col("p_partkey").cast("string"), F.lit('\t# Track: "'), title, F.lit('" by "'), F.col("p_brand"),
        F.lit('"(spotify:artist:a1), and Guest(spotify:artist:g2). Producer: Ann and Bob. Released on '), day, F.lit(". Descriptors: "), kinds, F.lit("."),
    )
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", title.alias("title"), packed.alias("packed"))


@REGISTRY.add(f"""SELECT p_partkey, {TITLE_SQL} AS track_name, [p_brand, 'Guest'] AS names, ['a1', 'g2'] AS uris, ['Ann', 'Bob'] AS producers,
(1960 + p_size)::VARCHAR || '-01-31' AS release_date, [lower(p_type), 'rock and roll', 'sad'] AS descriptors FROM part""")
def parse_packed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed names parsed back to the fields that they were made of."""
    parsed = titled(spark, sf_dir).select("p_partkey", text.parse_packed(F.col("packed")).alias("p")).where("p IS NOT NULL")
    return parsed.select("p_partkey", "p.track_name", F.col("p.artists.name").alias("names"), F.col("p.artists.uri").alias("uris"), "p.producers", "p.release_date", "p.descriptors")


@REGISTRY.add("""SELECT p_partkey, [lower(p_type), 'a and b', lower(p_brand), 'x'] AS parts FROM part""")
def split_list_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists split at commas and "and", but not in quotes."""
    packed = F.concat(F.col("p_type"), F.lit(', "A and B" and '), F.col("p_brand"), F.lit(", and x"))
    return table(spark, sf_dir, "part").select("p_partkey", text.split_quoted(packed).alias("parts"))


@REGISTRY.add(f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN p_name || ' Alive' ELSE p_name END AS canonical_name FROM part""")
def canonical_name_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without their version token."""
    return titled(spark, sf_dir).select("p_partkey", text.canonical_name(F.col("title")).alias("canonical_name"))


@REGISTRY.add(f"""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'live') OR p_partkey % 4 IN (1, 3) THEN 'live' WHEN p_partkey % 4 = 2 THEN 'remaster' ELSE 'original' END AS version_type FROM part""")
def version_type_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of each title's version; "Alive" counts as live."""
    return titled(spark, sf_dir).select("p_partkey", text.version_type(F.col("title")).alias("version_type"))


@REGISTRY.add("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN ['latin', 'pop'] WHEN p_size % 3 = 1 THEN ['r_and_b_soul'] ELSE ['unknown'] END AS genres,
CASE WHEN p_size % 3 = 1 THEN ['soulful', 'sad'] ELSE [] END AS moods FROM part""")
def classify_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All genres and moods of descriptors, each once and in order."""
    tags = F.when(F.col("p_size") % 3 == 0, F.array(*map(F.lit, ["salsa", "pop", "latin"]))).when(F.col("p_size") % 3 == 1, F.array(*map(F.lit, ["soulful", "sad", "soul"]))).otherwise(F.array(F.lit("none")))
    return table(spark, sf_dir, "part").select("p_partkey", text.classify(tags).alias("genres"), text.moods(tags).alias("moods"))


UNIFIED_SQL = """top AS (SELECT l_partkey AS uri, max_by(l_quantity::BIGINT, l_orderkey * 10 + l_linenumber) AS s, max_by(l_shipdate::VARCHAR, l_orderkey * 10 + l_linenumber) AS at FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey),
recent AS (SELECT l_partkey AS uri, max_by(l_quantity::BIGINT, l_orderkey * 10 + l_linenumber) AS s, max_by(l_shipdate::VARCHAR, l_orderkey * 10 + l_linenumber) AS at FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey),
unified AS (SELECT uri, coalesce(t.s, r.s) AS played_seconds, coalesce(r.at, t.at) AS last_played_at, r.uri IS NOT NULL AS is_recent FROM top t FULL JOIN recent r USING (uri))"""


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of two flags as the top and recent lists of an export, merged by part."""
    lines = table(spark, sf_dir, "lineitem")
    items = lambda flag: lines.where(F.col("l_returnflag") == flag).select(
        F.col("l_partkey").alias("uri"), F.lit(None).cast("string").alias("name"), F.col("l_quantity").cast("long").alias("played_seconds"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("last_played_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    return identity.by_uri(identity.occurrences(items("A"), items("R")))


@REGISTRY.add(f"WITH {UNIFIED_SQL} SELECT * FROM unified")
def unify_top_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists as one row for each uri: repeats overwrite, top seconds win, the last time holds."""
    return unified(spark, sf_dir).select("uri", "played_seconds", "last_played_at", "is_recent")


COLLAPSED_SQL = f"""{UNIFIED_SQL},
t AS (SELECT p_partkey AS uri, {TITLE_SQL} AS title, CASE p_partkey % 4 WHEN 3 THEN p_name || ' Alive' ELSE p_name END AS canonical_name, p_brand, 1960 + p_size AS y, u.*
    FROM unified u JOIN part ON p_partkey = u.uri),
collapsed AS (SELECT canonical_name, p_brand AS artist, arg_min(uri, length(title) * 1000000000 + uri) AS canonical_uri, sum(played_seconds)::BIGINT AS played_seconds, max(last_played_at) AS last_played_at,
    bool_or(is_recent) AS is_recent, list_sort(list(uri::VARCHAR)) AS uris, arg_min(y, length(title) * 1000000000 + uri) AS release_year FROM t GROUP BY ALL)"""


def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged items as canonical tracks."""
    names = titled(spark, sf_dir).select(F.col("p_partkey").alias("uri"), "p_brand", F.col("packed"))
    own = unified(spark, sf_dir).drop("name", "first_order").join(names, "uri").withColumnRenamed("packed", "name")
    own = own.withColumn("first_order", F.struct(F.lit(0).alias("part"), F.col("uri").alias("pos")))
    own = identity.parsed(own).withColumns({"artist_uris": F.array().cast("array<string>"), "uri": F.col("uri").cast("string")})
    return identity.versions_collapsed(own)


@REGISTRY.add(f"WITH {COLLAPSED_SQL} SELECT canonical_name, artist, canonical_uri::VARCHAR AS canonical_uri, played_seconds, last_played_at, is_recent, release_year, release_year // 10 * 10 AS decade FROM collapsed")
def collapse_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of one title and artist as one track."""
    return collapsed(spark, sf_dir).select("canonical_name", F.col("artist_names")[0].alias("artist"), "canonical_uri", "played_seconds", "last_played_at", "is_recent", "release_year", "decade")


@REGISTRY.add(f"WITH {COLLAPSED_SQL} SELECT canonical_name, uris FROM collapsed WHERE len(uris) > 1")
def uri_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uris of tracks that have several."""
    return identity.collisions(collapsed(spark, sf_dir))


@REGISTRY.add("""SELECT o_orderkey, year(o_orderdate)::INTEGER AS release_year, (year(o_orderdate) // 10 * 10)::INTEGER AS decade FROM orders""")
def release_decade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year and decade of a date kept as text."""
    year = text.release_year(F.col("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", year.alias("release_year"), text.decade(year).alias("decade"))


@REGISTRY.add("""SELECT DISTINCT unnest([lower(p_type), 'rock and roll', 'sad']) AS descriptor FROM part""")
def descriptor_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct descriptors."""
    parsed = titled(spark, sf_dir).select(text.parse_packed(F.col("packed"))["descriptors"].alias("descriptors"))
    return identity.vocabulary(parsed)


@REGISTRY.add("""SELECT coalesce(a.k, b.k) AS key, coalesce(a.name, b.name) AS name, b.id AS curated_id, a.k IS NOT NULL AS in_library FROM
(SELECT s_suppkey AS k, s_name AS name FROM supplier WHERE s_nationkey < 15) a FULL JOIN (SELECT s_suppkey AS k, s_name || '*' AS name, s_suppkey::VARCHAR AS id FROM supplier WHERE s_nationkey >= 10) b ON a.k = b.k""")
def upsert_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library and curated artists as one keyed union."""
    own = table(spark, sf_dir, "supplier")
    library = own.where("s_nationkey < 15").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    curated = own.where("s_nationkey >= 10").select(F.col("s_suppkey").alias("key"), F.concat("s_name", F.lit("*")).alias("name"), F.col("s_suppkey").cast("string").alias("curated_id"))
    return identity.upserted(library, curated)
