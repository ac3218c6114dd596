"""File sources and sinks with fixed schemas: exports, caches, graphs, histories; JSON, matrices, graph XML, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinity.functions import text

ITEM = "uri string, name string, played_seconds long, last_played_at string"
EXPORT = f"top_tracks struct<items:array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>>, recent_tracks struct<items:array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>>, meta struct<exported_at:string>"
MATCHES = "array<struct<name:string,match:double>>"
ARTIST = f"struct<name:string,spotify_uri:string,in_library:boolean,curated_id:string,wikidata_qid:string,genres:array<string>,similar:{MATCHES},lastfm_tags:array<string>>"
UNIVERSE = f"struct<name:string,depth:int,discovered_via:string,similar:{MATCHES},tags:array<string>>"
PARENTS = "array<string>"
EDGE = "`from` string, `to` string, type string, source string, confidence string, note string"
EDGE_TYPES = ["influenced", "sounds_like", "collaborated_with", "bridges_to", "part_of", "discovery_path", "family_connection"]
HISTORY = (
    "ts timestamp, ms_played long, master_metadata_track_name string, master_metadata_album_artist_name string, "
    "master_metadata_album_album_name string, spotify_track_uri string, reason_start string, reason_end string, shuffle boolean, skipped boolean"
)
GRAPH_NODE = "struct<id:string,name:string,genres:array<string>,era:string,nationality:string,will_response:string,playlists:array<string>,active:string,story:string,description:string>"
GRAPH = (
    f"nodes struct<artists:array<{GRAPH_NODE}>,genres:array<{GRAPH_NODE}>,concepts:array<{GRAPH_NODE}>>, "
    "edges array<struct<`from`:string,`to`:string,type:string,note:string>>, "
    "playlists array<struct<id:string,name:string,spotify_uri:string,theme:string,artist_nodes:array<string>>>, "
    "next_directions array<struct<item:string,artist:string,type:string,priority:string,note:string>>"
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern of any file system that Spark knows matches something."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON with a fixed schema; a missing file is an empty table, a missing key a null."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=not lines)


def read_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object as rows (key, value) with a fixed type of value; a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"key string, value {value}")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The top and recent items of an export, with their positions."""
    export = read_json(spark, path, EXPORT)
    items = lambda c: export.select(F.posexplode(f"{c}.items").alias("pos", "i")).select("i.*", "pos")
    return items("top_tracks"), items("recent_tracks")


def read_artists(spark: SparkSession, path: str) -> DataFrame:
    """The artist cache by name; of several entries of one name the last key stays."""
    rows = read_map(spark, path, ARTIST).withColumn("order", F.monotonically_increasing_id())
    return rows.groupBy("value.name").agg(F.max_by("value", "order").alias("v")).select("v.*")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """The crawled universe: name, depth, discovered_via, similar, tags."""
    return read_map(spark, path, UNIVERSE).select(F.coalesce("value.name", "key").alias("name"), "value.depth", "value.discovered_via", "value.similar", "value.tags")


def similar_edges(entities: DataFrame) -> DataFrame:
    """Directed edges of an entity table's ``similar`` lists: src, dst, match."""
    return entities.select(F.col("name").alias("src"), F.explode("similar").alias("s")).select("src", F.col("s.name").alias("dst"), F.col("s.match").alias("match"))


def read_parents(spark: SparkSession, path: str) -> DataFrame:
    """A hierarchy of ordered parents: child, pos, parent."""
    return read_map(spark, path, PARENTS).select(F.col("key").alias("child"), F.posexplode("value").alias("pos", "parent"))


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A curated property graph: a table for artists, genres, concepts, edges, playlists, next_directions."""
    graph = read_json(spark, path, GRAPH)
    rows = lambda c: graph.select(F.explode(c).alias("x")).select("x.*")
    edges = rows("edges").withColumnsRenamed({"from": "src", "to": "dst"})
    return {**{k: rows(f"nodes.{k}") for k in ("artists", "genres", "concepts")}, "edges": edges, "playlists": rows("playlists"), "next_directions": rows("next_directions")}


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Influence edges of known types: src, dst, type, source, confidence, note."""
    return read_json(spark, path, EDGE).withColumnsRenamed({"from": "src", "to": "dst"}).where(F.col("type").isin(EDGE_TYPES))


def read_history(spark: SparkSession, pattern: str) -> DataFrame:
    """A streaming history of any number of files."""
    return read_json(spark, pattern, HISTORY)


def stream_history(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream of files."""
    return spark.readStream.schema(HISTORY).json(folder, multiLine=True)


def write_json(df: DataFrame, path: str, single: bool = False, sorted_keys: bool = False) -> None:
    """JSON lines; one file if ``single``, for small results only. Keys are in the columns' order, or by name."""
    own = df.select(*sorted(df.columns)) if sorted_keys else df
    (own.coalesce(1) if single else own).write.mode("overwrite").json(path)


def json_map(df: DataFrame, key: str, pretty: bool = False) -> DataFrame:
    """A small table as one JSON object by a key, keys and fields sorted: one row (json)."""
    fields = F.struct(*[F.col(c) for c in sorted(df.columns) if c != key])
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), fields.alias("v")))))
    return df.agg(F.to_json(entries, {"pretty": str(pretty).lower()}).alias("json"))


#: Rows of a document, when a table is written as several JSON documents.
DOCUMENT_ROWS = 50_000


def in_pieces(rows: DataFrame, *by: str, most: int = DOCUMENT_ROWS) -> DataFrame:
    """Adds ``piece``: by hash, about ``most`` rows of each; rows that agree in ``by`` are in one."""
    pieces = max(1, -(-rows.count() // most))
    return rows.withColumn("piece", F.pmod(F.xxhash64(*by), F.lit(pieces)).cast("int"))


def write_documents(documents: DataFrame, column: Column, path: str) -> None:
    """A text for each row (one a ``piece``), each in a file of its own, so that as many tasks read them as there are."""
    documents.select("piece", column.alias("value")).write.mode("overwrite").partitionBy("piece").text(path)


def write_json_maps(df: DataFrame, key: str, path: str, most: int = DOCUMENT_ROWS) -> None:
    """A table of any size as JSON objects by a key, keys sorted in each, one object a file; ``read_map`` reads them all."""
    fields = F.struct(*[F.col(c) for c in sorted(df.columns) if c != key])
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), fields.alias("v")))))
    write_documents(in_pieces(df, key, most=most).groupBy("piece").agg(F.to_json(entries).alias("json")), F.col("json"), path)


def write_matrix(points: DataFrame, path: str) -> None:
    """Vectors as Parquet, sorted by name within files."""
    points.select("node", F.transform("vector", lambda x: x.cast("float")).alias("vector")).sortWithinPartitions("node").write.mode("overwrite").parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """All columns as strings: nulls empty, lists comma-joined."""

    def one(field: T.StructField) -> Column:
        own = F.col(f"`{field.name}`")
        own = F.array_join(own.cast("array<string>"), ", ") if isinstance(field.dataType, T.ArrayType) else own.cast("string")
        return F.coalesce(own, F.lit("")).alias(field.name)

    return df.select(*map(one, df.schema.fields))


def graph_xml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a GraphML document for nodes (node, ...) and edges (src, dst, ...), in order: part, line."""
    entity = lambda c: text.escaped(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")))

    def data(df: DataFrame, skip: tuple) -> Column:
        return F.concat(F.lit(""), *[F.concat(F.lit(f'<data key="{c}">'), entity(F.col(f"`{c}`")), F.lit("</data>")) for c in df.columns if c not in skip])

    n, e = flat(nodes), flat(edges)
    head = nodes.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="undirected">').alias("line"))
    rows = n.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), entity(F.col("node")), F.lit('">'), data(n, ("node",)), F.lit("</node>")).alias("line"))
    links = e.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), entity(F.col("src")), F.lit('" target="'), entity(F.col("dst")), F.lit('">'), data(e, ("src", "dst")), F.lit("</edge>")).alias("line"))
    tail = nodes.sparkSession.range(1).select(F.lit(3).alias("part"), F.lit("</graph></graphml>").alias("line"))
    return head.union(rows).union(links).union(tail)


def write_lines(lines: DataFrame, path: str, order: list[str], column: str = "line") -> None:
    """Text lines in an order, sorted range by range over as many files as they need."""
    lines.orderBy(*order).select(column).write.mode("overwrite").text(path)


def refreshed(fetched: DataFrame, old: DataFrame) -> DataFrame:
    """Fetched items (uri, name, last_played_at) merged with known ones (uri, name, played_seconds, last_played_at).

    A known uri keeps its metadata and seconds, and its time unless a new one
    came; a new uri starts at 0 seconds; known uris that weren't fetched go.
    """
    known = old.select("uri", F.col("name").alias("old_name"), "played_seconds", F.col("last_played_at").alias("old_at"))
    both = fetched.join(known, "uri", "left")
    return both.select("uri", F.coalesce("old_name", "name").alias("name"), F.coalesce("played_seconds", F.lit(0)).alias("played_seconds"), F.coalesce("last_played_at", "old_at").alias("last_played_at"))


def packed_name(uri: Column, title: Column, artists: Column, released: Column) -> Column:
    """A minimal packed name; ``artists`` are structs (name, id)."""
    credit = F.array_join(F.transform(artists, lambda a: F.concat(F.lit('"'), a["name"], F.lit('"(spotify:artist:'), a["id"], F.lit(")"))), " and ")
    return F.concat(uri, F.lit('\t# Track: "'), title, F.lit('" by '), credit, F.lit(". Released on "), released, F.lit(". Descriptors: unknown."))
