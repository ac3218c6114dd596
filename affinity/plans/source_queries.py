"""Queries that write what the engine reads, read it back and work on it: exports, caches, graphs, histories, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.operators import atlas, identity, layers, temporal, traversal
from affinity.operators.session import cut, scratch
from affinity.plans.graph_queries import CO_SQL, PLAYS_SQL, plays, strong
from affinity.plans.registry import Registry, table
from affinity.sources import files

REGISTRY = Registry()


#: Rows of one written document: few, so that also the smallest tables make several files.
ROWS = 500


def objects(rows: DataFrame, key: str) -> str:
    """The folder of JSON objects that hold a table by key."""
    path = scratch(rows.sparkSession)
    files.write_json_maps(rows, key, path, ROWS)
    return path


def _listed(rows: DataFrame, *columns: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(*columns)))


@REGISTRY.add("""SELECT p_partkey::VARCHAR AS uri, p_name AS name, p_size::BIGINT AS played_seconds, CASE WHEN p_size > 25 THEN 'day' || p_size END AS last_played_at, p_size > 25 AS recent FROM part WHERE p_partkey > 0""")
def export_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of an export, top and recent ones, read with their fixed schema."""
    part = table(spark, sf_dir, "part").where("p_partkey > 0")
    rows = part.select(F.col("p_partkey").cast("string").alias("uri"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("played_seconds"), F.when(F.col("p_size") > 25, F.concat(F.lit("day"), F.col("p_size").cast("string"))).alias("last_played_at"))
    item = F.struct("uri", "name", "played_seconds", "last_played_at")
    pick = lambda recent: F.struct(F.collect_list(F.when((F.col("played_seconds") > 25) == F.lit(recent), item)).alias("items"))
    exports = files.in_pieces(rows, "uri", most=ROWS).groupBy("piece").agg(F.struct(pick(False).alias("top_tracks"), pick(True).alias("recent_tracks")).alias("e"))
    path = scratch(spark)
    files.write_documents(exports, F.to_json("e"), path)
    top, recent = files.read_export(spark, path)
    return top.withColumn("recent", F.lit(False)).unionByName(recent.withColumn("recent", F.lit(True))).drop("pos")


CACHE_SQL = f"""WITH {CO_SQL}, d AS (SELECT src, dst, weight / 10.0::DOUBLE AS match FROM strong)
SELECT a.p_name || '/' || d.src AS src, b.p_name || '/' || d.dst AS dst, match FROM d JOIN part a ON a.p_partkey = d.src JOIN part b ON b.p_partkey = d.dst"""


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their matches: key, name, depth, similar, tags."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").alias("depth"), F.array("p_brand").alias("tags"))
    near = strong(spark, sf_dir).join(part.select(F.col("id").alias("dst"), F.col("name").alias("other")), "dst")
    near = near.groupBy(F.col("src").alias("id")).agg(F.collect_list(F.struct(F.col("other").alias("name"), (F.col("weight") / 10.0).alias("match"))).alias("similar"))
    return part.join(near, "id", "left").select("name", F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "depth", "tags", "similar")


@REGISTRY.add(CACHE_SQL)
def cache_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match edges of an artist cache, read from one JSON object."""
    own = _cache(spark, sf_dir).select("key", "name", "similar", F.col("tags").alias("genres"))
    return files.similar_edges(files.read_artists(spark, objects(own, "key")))


@REGISTRY.add("SELECT p_name || '/' || p_partkey AS name, p_size AS depth, [p_brand] AS tags FROM part")
def universe_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of a crawled universe."""
    own = _cache(spark, sf_dir).drop("key")
    keyed = own.withColumn("key", F.col("name"))
    return files.read_universe(spark, objects(keyed, "key")).select("name", "depth", "tags")


@REGISTRY.add(f"""WITH {CO_SQL} SELECT a.p_name AS src, b.p_name AS dst, CASE WHEN weight > 2 THEN 'influenced' ELSE 'sounds_like' END AS type, CASE WHEN weight > 3 THEN 'n' || weight END AS note
FROM strong s JOIN part a ON a.p_partkey = s.src JOIN part b ON b.p_partkey = s.dst""")
def property_graph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of a property graph by its nodes' names."""
    node = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    nodes = files.in_pieces(table(spark, sf_dir, "part"), "p_partkey", most=ROWS).groupBy("piece").agg(F.collect_list(node).alias("artists"))
    edge = F.struct(F.col("src").cast("string").alias("from"), F.col("dst").cast("string").alias("to"), F.when(F.col("weight") > 2, "influenced").otherwise("sounds_like").alias("type"), F.when(F.col("weight") > 3, F.concat(F.lit("n"), F.col("weight").cast("string"))).alias("note"))
    edges = files.in_pieces(cut(strong(spark, sf_dir)), "src", "dst", most=ROWS).groupBy("piece").agg(F.collect_list(edge).alias("edges"))
    both = nodes.join(edges, "piece", "full").select("piece", F.struct("artists", F.array().cast("array<struct<id:string>>").alias("genres")).alias("nodes"), "edges")
    path = scratch(spark)
    files.write_documents(both, F.to_json(F.struct("nodes", "edges")), path)
    graph = files.read_graph(spark, path)
    return layers.resolved(graph["edges"], graph["artists"].select("id", "name"))


@REGISTRY.add("""SELECT event_id::VARCHAR AS uri, ts AS at, CASE WHEN value IS NULL THEN 0 ELSE floor(value * 1000)::BIGINT END / 1000.0::DOUBLE AS seconds, event_type = 'error' OR floor(value * 1000) < 30000 AS is_skip FROM events WHERE value IS NOT NULL""")
def history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A streaming history read from files, with skips marked."""
    events = table(spark, sf_dir, "events").where("value IS NOT NULL")
    path = scratch(spark)
    rows = events.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.floor(F.col("value") * 1000).cast("long").alias("ms_played"), F.col("event_id").cast("string").alias("spotify_track_uri"), (F.col("event_type") == "error").alias("skipped"))
    rows.write.json(path)
    read = files.read_json(spark, path, files.HISTORY, lines=True)
    return temporal.skip_flags(read).select(F.col("spotify_track_uri").alias("uri"), F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("at"), "seconds", "is_skip")


@REGISTRY.add("SELECT vec_id AS node, embedding::FLOAT[] AS vector FROM embeddings")
def matrix_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as a matrix and read again."""
    path = scratch(spark)
    files.write_matrix(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector")), path)
    return spark.read.parquet(path)


@REGISTRY.add("SELECT o_orderkey AS id, ['c' || o_custkey % 5] AS composers FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, ['w' || o_custkey % 3] FROM orders WHERE o_orderstatus = 'F'")
def composer_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composers of packed names, writers where none is named."""
    from affinity.functions import text

    orders, who = table(spark, sf_dir, "orders"), F.col("o_custkey")
    credit = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("Composer: c"), (who % 5).cast("string"), F.lit(". Writer: x. "))).otherwise(F.concat(F.lit("Writer: w"), (who % 3).cast("string"), F.lit(". ")))
    packed = F.concat(F.lit('u\t# Track: "T" by "A"(spotify:artist:I). '), credit, F.lit("Released on 2020-01-01. Descriptors: sad."))
    return orders.select(F.col("o_orderkey").alias("id"), text.parse_packed(packed)["composers"].alias("composers"))


@REGISTRY.add(f"""WITH {PLAYS_SQL}, c AS (SELECT DISTINCT brand AS composer, item FROM plays) SELECT composer, count(*) AS tracks, list_sort(list(item)) AS items FROM c GROUP BY composer HAVING count(*) > 1""")
def composer_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks that share a composer."""
    return identity.shared_credits(plays(spark, sf_dir).select("item", F.array("brand").alias("composers")), "item", "composers")


@REGISTRY.add(f"""WITH {PLAYS_SQL}, t AS (SELECT genre, item, sum(seconds)::BIGINT AS s, min(year(o_orderdate)) AS y FROM plays JOIN orders ON o_orderkey = o GROUP BY ALL)
SELECT genre, count(*) AS track_count, sum(s)::BIGINT AS seconds, round(avg(y), 6) AS average_year FROM t GROUP BY genre""")
def genre_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tracks, seconds and mean release year of each genre."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.year("o_orderdate").alias("release_year"))
    tracks = plays(spark, sf_dir).join(orders, "o").groupBy("genre", "item").agg(F.sum("seconds").alias("played_seconds"), F.min("release_year").alias("release_year"))
    return layers.genre_profile(tracks.select(F.array("genre").alias("macros"), "played_seconds", "release_year")).withColumn("average_year", F.round("average_year", 6))


@REGISTRY.add(f"""WITH {CO_SQL}, chosen AS (SELECT p_partkey AS node FROM part WHERE p_size > 20) SELECT src, dst, weight FROM strong WHERE src IN (SELECT node FROM chosen) AND dst IN (SELECT node FROM chosen)""")
def node_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges among chosen nodes."""
    return traversal.among(strong(spark, sf_dir), table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("node")))


@REGISTRY.add(f"""WITH {CO_SQL} SELECT 1 AS part, '{{"id":"' || p_partkey || '","label":"' || p_name || '","group":"' || p_type || '"}}' AS line FROM part
UNION ALL SELECT 2, '{{"from":"' || src || '","to":"' || dst || '","value":' || weight || '}}' FROM strong""")
def network_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an interactive network page shows: a JSON line for each node and edge."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("label"), F.col("p_type").alias("kind"))
    return atlas.network_elements(nodes, strong(spark, sf_dir))


@REGISTRY.add("SELECT p_partkey::VARCHAR AS key, p_name AS name, p_size AS size, [p_brand, p_type] AS tags FROM part")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as JSON objects of some rows each, in files of their own, and read by as many tasks."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.array("p_brand", "p_type").alias("tags"))
    return files.read_map(spark, objects(part, "key"), "struct<name:string,size:int,tags:array<string>>").select("key", "value.*")
