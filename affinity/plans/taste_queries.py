"""Queries over genres, the map, the curated graph, reports and recommendations.

Suppliers stand for artists, brands for genres, parts for tracks. An artist has
the genres of what it played long; genres of the fifth maker aren't in the taxonomy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.functions import text
from affinity.operators import atlas, curated, evaluate, frontier, genres, layers, metrics, order, report, temporal, traversal
from affinity.operators.session import scratch
from affinity.plans.graph_queries import CO_SQL, KNN_SQL, LIBRARY_SQL, MATCH_SQL, PLAYS_SQL, directed, library, plays, strong
from affinity.plans.registry import Registry, table
from affinity.sources import files

REGISTRY = Registry()
LONG = 45
ARTISTS_SQL = f"""{PLAYS_SQL},
artists AS (SELECT who AS artist, list_sort(list(DISTINCT brand)) AS genres FROM plays WHERE seconds >= {LONG} GROUP BY who),
seconds AS (SELECT who AS artist, sum(seconds)::BIGINT AS seconds FROM plays GROUP BY who),
parents AS (SELECT DISTINCT p_brand AS child, CASE WHEN p_brand LIKE '%1' THEN 'music' ELSE 'Maker ' || substr(p_brand, 7, 1) END AS parent FROM part WHERE p_brand NOT LIKE 'Brand#5%'),
placed AS (SELECT child AS genre, CASE WHEN parent = 'music' THEN [child] ELSE [child, parent] END AS path, CASE WHEN parent = 'music' THEN child ELSE parent END AS meta FROM parents)"""


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists with their genres: artist, genres."""
    own = plays(spark, sf_dir).where(F.col("seconds") >= LONG)
    return own.groupBy(F.col("who").alias("artist")).agg(F.array_sort(F.collect_set("brand")).alias("genres"))


def seconds_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seconds of each artist: artist, seconds."""
    return plays(spark, sf_dir).groupBy(F.col("who").alias("artist")).agg(F.sum("seconds").alias("seconds"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxonomy of the observed genres that a maker's hierarchy has: genre, path, meta."""
    parents = table(spark, sf_dir, "part").select(F.col("p_brand").alias("child")).distinct().where("child NOT LIKE 'Brand#5%'")
    parents = parents.select("child", F.lit(0).alias("pos"), F.when(F.col("child").endswith("1"), "music").otherwise(F.concat(F.lit("Maker "), F.substring("child", 7, 1))).alias("parent"))
    found = genres.observed(artists(spark, sf_dir)).join(parents.select(F.col("child").alias("genre")), "genre", "left_semi")
    return genres.taxonomy(found, parents)


@REGISTRY.add(f"WITH {ARTISTS_SQL} SELECT genre, path, meta FROM placed WHERE genre IN (SELECT unnest(genres) FROM artists)")
def observed_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed genres with their paths and meta genres."""
    return placed(spark, sf_dir)


@REGISTRY.add(f"""WITH {ARTISTS_SQL}, e AS (SELECT artist, unnest(genres) AS genre FROM artists)
SELECT artist, coalesce(list_sort(list(DISTINCT meta) FILTER (meta IS NOT NULL)), []) AS meta_genres FROM e LEFT JOIN placed USING (genre) GROUP BY artist""")
def artist_meta_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The meta genres of each artist."""
    return genres.meta_genres(artists(spark, sf_dir), placed(spark, sf_dir), "artist")


@REGISTRY.add(f"""WITH {ARTISTS_SQL}, e AS (SELECT artist, genre, meta FROM (SELECT artist, unnest(genres) AS genre FROM artists) JOIN placed USING (genre)),
s AS (SELECT genre, meta, seconds / count(*) OVER (PARTITION BY artist)::DOUBLE AS v FROM e JOIN seconds USING (artist)),
r AS (SELECT meta, genre, round(sum(v), 6) AS value FROM s GROUP BY ROLLUP (meta, genre))
SELECT CASE WHEN meta IS NULL THEN 'Taste' WHEN genre IS NULL THEN 'meta::' || meta ELSE 'genre::' || genre END AS id, CASE WHEN meta IS NULL THEN 'Taste' ELSE coalesce(genre, meta) END AS label,
CASE WHEN meta IS NULL THEN '' WHEN genre IS NULL THEN 'Taste' ELSE 'meta::' || meta END AS parent, value FROM r""")
def genre_split_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sunburst's tree: time split evenly over each artist's genres of the taxonomy, summed up to its root."""
    return genres.tree(genres.split_seconds(seconds_of(spark, sf_dir), artists(spark, sf_dir), placed(spark, sf_dir)))


NAMES_SQL = "names AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size > 10)"


@REGISTRY.add(f"""WITH {CO_SQL}, {NAMES_SQL}
SELECT coalesce(a.name, s.src::VARCHAR) AS src, coalesce(b.name, s.dst::VARCHAR) AS dst, CASE WHEN s.weight > 3 THEN 'often' ELSE '' END AS note
FROM strong s LEFT JOIN names a ON a.id = s.src LEFT JOIN names b ON b.id = s.dst WHERE s.weight > 2""")
def discovery_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of one type by name, ids without a name as they are."""
    weight = F.col("weight")
    edges = strong(spark, sf_dir).select(
        F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"),
        F.when(weight > 2, "discovery_path").otherwise("influenced").alias("type"), F.when(weight > 3, "often").alias("note"),
    )
    names = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    return curated.discovery_paths(edges, names)


def _scored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") > 10, "artist").otherwise("genre")
    degree = layers.degrees(strong(spark, sf_dir))
    nodes = part.select(F.col("p_partkey").alias("node"), kind.alias("kind"), (F.col("p_retailprice") / 1e5).alias("betweenness"))
    return metrics.attached(nodes, degree)


SCORED_SQL = f"""WITH {CO_SQL}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM strong UNION ALL SELECT dst FROM strong) GROUP BY node),
nodes AS (SELECT p_partkey AS node, CASE WHEN p_size > 10 THEN 'artist' ELSE 'genre' END AS kind, p_retailprice / 1e5::DOUBLE AS betweenness, degree FROM part LEFT JOIN d ON d.node = p_partkey)"""


@REGISTRY.add(SCORED_SQL + " SELECT * FROM nodes")
def attached_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the columns of a metric."""
    return _scored_nodes(spark, sf_dir)


@REGISTRY.add(SCORED_SQL + """, b AS (SELECT 'betweenness' AS metric, row_number() OVER (ORDER BY betweenness DESC, node)::INTEGER AS rank, node, betweenness AS value FROM nodes WHERE kind = 'artist'),
g AS (SELECT 'degree' AS metric, row_number() OVER (ORDER BY degree DESC, node)::INTEGER AS rank, node, degree::DOUBLE AS value FROM nodes WHERE kind = 'artist' AND degree IS NOT NULL)
SELECT * FROM b WHERE rank <= 10 UNION ALL SELECT * FROM g WHERE rank <= 10""")
def top_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten artists that have most of each metric."""
    nodes = _scored_nodes(spark, sf_dir).withColumn("degree", F.col("degree").cast("double"))
    return metrics.top_lists(nodes.where("kind = 'artist' AND (degree IS NOT NULL OR betweenness IS NOT NULL)"), ["betweenness", "degree"])


@REGISTRY.add(SCORED_SQL + """, b AS (SELECT node, betweenness, row_number() OVER (ORDER BY betweenness DESC, node) AS pos FROM nodes WHERE kind = 'artist')
SELECT pos, '- **' || node || '** — betweenness ' || printf('%.4f', betweenness) AS line FROM b WHERE pos <= 15""")
def bridge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the 15 artists that lie most between others."""
    return report.bridge_lines(frontier.bridges(_scored_nodes(spark, sf_dir)))


@REGISTRY.add(f"""WITH {MATCH_SQL}, {LIBRARY_SQL}, loved AS (SELECT p_partkey AS node FROM part WHERE p_size >= 40),
f AS (SELECT dst AS node, round(sum(CASE WHEN src IN (SELECT node FROM loved) THEN match * 1.5::DOUBLE ELSE match END), 9) AS score, list_sort(list(DISTINCT src))[1:4] AS via
FROM directed WHERE src IN (SELECT node FROM library) AND dst NOT IN (SELECT node FROM library) GROUP BY dst ORDER BY score DESC, node LIMIT 20)
SELECT row_number() OVER (ORDER BY score DESC, node) AS pos, '- [ ] **' || node || '** (score ' || printf('%.2f', round_even(score, 2)) || ') — similar to ' || array_to_string(via, ', ') AS line FROM f""")
def frontier_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discovery frontier as a checklist."""
    loved = table(spark, sf_dir, "part").where("p_size >= 40").select(F.col("p_partkey").alias("node"))
    return report.scored_checklist(frontier.discovery_frontier(directed(spark, sf_dir), library(spark, sf_dir), loved))


@REGISTRY.add("""WITH n AS (SELECT s_name AS stem, '---' || chr(10) || 'name: ' || s_name || chr(10) || '---' || chr(10) || 'Body' AS content, s_suppkey AS k, s_nationkey AS t FROM supplier)
SELECT stem, CASE WHEN k % 2 = 0 THEN '---' || chr(10) || 'name: ' || stem || chr(10) || 'meta_genres: [m' || t || ']' || chr(10) || 'lastfm_tags: [a, b]' || chr(10) || '---' || chr(10) || 'Body' ELSE content END AS content FROM n""")
def note_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes joined with artists by file name; lists go into the front matter of those that fit one."""
    own = table(spark, sf_dir, "supplier")
    notes = own.select(F.col("s_name").alias("stem"), F.concat(F.lit("---\nname: "), F.col("s_name"), F.lit("\n---\nBody")).alias("content"))
    found = own.where("s_suppkey % 2 = 0").select(  # artists of the other notes are unknown
        F.concat(F.lit("?"), "s_name", F.lit("*")).alias("name"), F.array(F.concat(F.lit("m"), F.col("s_nationkey").cast("string"))).alias("meta_genres"), F.array(F.lit("a"), F.lit("b")).alias("lastfm_tags")
    )
    return report.enriched_notes(notes, found)


BUCKET_SQL = """tagged AS (SELECT p_partkey AS node, CASE WHEN p_type = 'ECONOMY' THEN 'untagged' ELSE p_brand END AS tag FROM part),
top AS (SELECT tag FROM tagged GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 14),
buckets AS (SELECT node, CASE WHEN tag IN (SELECT tag FROM top) THEN tag ELSE 'other' END AS bucket FROM tagged)"""


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("p_type") == "ECONOMY", F.array(F.lit("American"))).otherwise(F.array(F.lit("USA"), "p_brand"))
    return frontier.tag_buckets(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), tags.alias("tags")), "tags")


@REGISTRY.add(f"""WITH {BUCKET_SQL}, c AS (SELECT bucket, count(*) AS n FROM buckets GROUP BY bucket)
SELECT row_number() OVER (ORDER BY bucket = 'other', n DESC, bucket) AS pos, '| ' || bucket || ' | ' || n || ' |' AS line FROM c""")
def territory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named territories of the map and how many nodes each has."""
    return report.territory_lines(_buckets(spark, sf_dir))


PLACES_SQL = "places AS (SELECT s_suppkey AS node, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier WHERE s_suppkey % 7 > 0)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of artists; one in seven has none, as it wasn't embedded."""
    return table(spark, sf_dir, "supplier").where("s_suppkey % 7 > 0").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))


@REGISTRY.add(f"""WITH {PLACES_SQL}, own AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS m FROM lineitem),
e AS (SELECT a.m AS src, b.m AS dst, count(*) AS weight FROM own a JOIN own b ON a.g = b.g AND a.m < b.m GROUP BY ALL)
SELECT e.src, e.dst, weight, a.x AS src_x, a.y AS src_y, b.x AS dst_x, b.y AS dst_y FROM e JOIN places a ON a.node = e.src JOIN places b ON b.node = e.dst""")
def atlas_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between embedded artists with the places of both."""
    return atlas.placed_edges(layers.pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey"), _places(spark, sf_dir))


@REGISTRY.add(f"""WITH {PLAYS_SQL}, {PLACES_SQL}, s AS (SELECT who AS node, sum(seconds)::BIGINT AS seconds FROM plays WHERE who % 3 = 0 GROUP BY who),
o AS (SELECT node, x, y, seconds FROM places JOIN s USING (node))
SELECT node, x, y, seconds, 8.0::DOUBLE + 32.0::DOUBLE * seconds / (SELECT max(seconds) FROM o) AS size FROM o""")
def atlas_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library (every third artist) on the map, sized by play time."""
    tracks = plays(spark, sf_dir).where("who % 3 = 0").select(F.array("who").alias("artist_names"), F.col("seconds").alias("played_seconds"))
    return atlas.library_overlay(_places(spark, sf_dir), atlas.play_seconds(tracks))


@REGISTRY.add(f"""WITH {KNN_SQL.format(k=8)}, h AS (SELECT id, array_to_string(list('v' || other ORDER BY rank) FILTER (rank <= 5), ', ') AS near FROM near GROUP BY id)
SELECT vec_id AS node, '<b>v' || vec_id || '</b><br>tag: ' || CASE WHEN label = 0 THEN '?' ELSE '&lt;' || label || '&gt;' END || '<br>nearest: ' || near AS line FROM embeddings JOIN h ON h.id = vec_id""")
def atlas_hover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text shown for each point of the map."""
    points = table(spark, sf_dir, "embeddings")
    name = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"))
    near = frontier.nearest(points, "vec_id", "embedding").select(F.col("id").alias("node"), "rank", name("other").alias("name"))
    tags = F.when(F.col("label") == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("<"), F.col("label").cast("string"), F.lit(">"))))
    return atlas.hover_lines(points.select(F.col("vec_id").alias("node"), name("vec_id").alias("label"), tags.alias("tags")), near)


REACH_SQL = f"""WITH RECURSIVE {CO_SQL}, ways AS (SELECT src, dst FROM strong UNION SELECT dst, src FROM strong),
liked AS (SELECT p_partkey AS node FROM part WHERE p_size = 50),
w(node, hops) AS (SELECT node, 0 FROM liked UNION SELECT dst, hops + 1 FROM w JOIN ways ON src = node WHERE hops < 3),
around AS (SELECT node, min(hops)::INTEGER AS hops FROM w GROUP BY node),
scored AS (SELECT p_partkey AS node, hops, coalesce(1 / (hops + 1)::DOUBLE, 0.0) AS score FROM part LEFT JOIN around ON node = p_partkey)"""


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    liked = part.where("p_size = 50").select(F.col("p_partkey").alias("node"))
    return curated.scored_by_distance(part.select(F.col("p_partkey").alias("node")), strong(spark, sf_dir), liked)


@REGISTRY.add(REACH_SQL + " SELECT * FROM scored")
def distance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks by their distance from liked ones."""
    return _distances(spark, sf_dir)


@REGISTRY.add(REACH_SQL + """, o AS (SELECT DISTINCT l_orderkey AS playlist, l_partkey AS node FROM lineitem)
SELECT playlist, count(*) AS size, round(avg(coalesce(score, 0)), 9) AS score FROM o LEFT JOIN scored USING (node) GROUP BY playlist""")
def playlist_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as playlists, by how near their tracks are to liked ones."""
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("playlist")).agg(F.collect_set("l_partkey").alias("nodes"))
    return curated.playlist_scores(lists, _distances(spark, sf_dir)).withColumn("score", F.round("score", 9))


@REGISTRY.add(f"""WITH {PLAYS_SQL}, s AS (SELECT item AS node, sum(seconds)::BIGINT AS seconds FROM plays GROUP BY item)
SELECT node, seconds FROM s WHERE seconds >= 900 AND node NOT IN (SELECT p_partkey FROM part WHERE p_size > 20)""")
def curated_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Much-played tracks that the curated graph doesn't know."""
    played = plays(spark, sf_dir).groupBy(F.col("item").alias("node")).agg(F.sum("seconds").alias("seconds"))
    return curated.gaps(played, table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("node")), 900)


@REGISTRY.add(f"""WITH {PLAYS_SQL}, s AS (SELECT who AS node, sum(seconds)::BIGINT AS seconds FROM plays GROUP BY who),
d AS (SELECT o_orderkey AS item, o_custkey AS node, CASE left(o_orderpriority, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium' ELSE 'low' END AS priority FROM orders)
SELECT item, priority, coalesce(seconds, 0) AS seconds FROM d LEFT JOIN s USING (node) ORDER BY CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, seconds DESC, item LIMIT 20""")
def next_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to explore next."""
    first = F.left("o_orderpriority", F.lit(1))
    ways = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("node"), F.when(first == "1", "high").when(first == "2", "medium").otherwise("low").alias("priority"))
    return curated.next_directions(ways, seconds_of(spark, sf_dir).withColumnRenamed("artist", "node"))


BLEND_SQL = "WITH b AS (SELECT p_partkey AS node, p_retailprice AS score, CASE WHEN p_size % 10 = 0 THEN 'single-listen' WHEN p_size % 10 = 1 THEN 'loved' END AS response, p_size > 25 AS old FROM part)"


@REGISTRY.add(BLEND_SQL + """, k AS (SELECT *, 'known' AS kind FROM b WHERE old AND coalesce(response, '') <> 'single-listen' ORDER BY score DESC, node LIMIT 12),
n AS (SELECT *, 'new' AS kind FROM b WHERE NOT old AND coalesce(response, '') <> 'single-listen' ORDER BY score DESC, node LIMIT 8)
SELECT node, score, response, kind FROM k UNION ALL SELECT node, score, response, kind FROM n""")
def blended_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty items, three known for two new ones, without those that didn't land."""
    tens = F.col("p_size") % 10
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("score"), F.when(tens == 0, "single-listen").when(tens == 1, "loved").alias("response"), "p_size")
    return frontier.blend(own.where("p_size > 25").drop("p_size"), own.where("p_size <= 25").drop("p_size"), 20)


TRACKS_SQL = """tracks AS (SELECT o_orderkey AS id, o_custkey % 10 AS mode, [lower(left(o_orderpriority, 1)), lower(o_orderstatus)] AS descriptors, [lower(o_orderstatus)] AS macros,
    floor(o_totalprice)::BIGINT AS seconds, year(o_orderdate) AS y, o_custkey AS c FROM orders)"""
STATES, RANKS = ["f", "o", "p"], ["1", "2", "3", "4", "5"]


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, state = F.lower(F.left("o_orderpriority", F.lit(1))), F.lower("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("mode"), F.array(first, state).alias("descriptors"), F.array(state).alias("macros"),
        F.floor("o_totalprice").cast("long").alias("played_seconds"), F.year("o_orderdate").alias("release_year"),
    )


@REGISTRY.add(f"""WITH {TRACKS_SQL}, m AS (SELECT max(ln(1 + seconds::DOUBLE)) AS top, min(y) AS low, max(y) AS high FROM tracks),
v AS (SELECT id, list_transform({[*RANKS, *STATES]}, lambda x: list_contains(descriptors, x)::INT::DOUBLE) || [ln(1 + seconds::DOUBLE) / top, (y - low) / greatest(high - low, 1)::DOUBLE] || list_transform({STATES}, lambda x: list_contains(macros, x)::INT::DOUBLE) AS v FROM tracks, m)
SELECT id, list_transform(v, lambda x: round(x, 9)) AS vector FROM v""")
def track_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors by which tracks are compared."""
    found = frontier.track_features(_tracks(spark, sf_dir), "id", [*RANKS, *STATES], STATES)
    return found.withColumn("vector", F.transform("vector", lambda x: F.round(x, 9)))


@REGISTRY.add()
def more_like_this(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten tracks most like each track whose id is divisible by 100; tested against brute force."""
    own = _tracks(spark, sf_dir)
    return frontier.more_like(own, "id", [*RANKS, *STATES], STATES, asked=own.where("id % 100 = 0").select("id"))


AXES = {"energy": (["club", "electronic", "trap"], ["calm", "acoustic", "cozy"]), "valence": (["romantic", "love"], ["sad", "melancholy"])}
WORDS = ["club", "trap", "calm", "cozy", "love", "sad", "slow"]


@REGISTRY.add(f"""WITH t AS (SELECT o_custkey % 10 AS mode, [{WORDS}[1 + o_orderkey % 7], {WORDS}[1 + o_custkey % 7]] AS d, [lower(o_orderstatus)] AS macros, year(o_orderdate) AS y FROM orders),
c AS (SELECT mode, list_distinct(d) AS d, macros, y FROM t)
SELECT mode, {", ".join(f"round(avg(len(list_intersect(d, {high})) - len(list_intersect(d, {low}))), 9) AS {axis}" for axis, (high, low) in AXES.items())},
round(avg((y >= 2000)::INT), 9) AS era, count(DISTINCT macros[1]) AS spread, count(*) AS n FROM c GROUP BY mode""")
def taste_compass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tracks of each mode point."""
    words = F.array(*map(F.lit, WORDS))
    at = lambda c: F.get(words, (F.col(c) % len(WORDS)).cast("int"))
    own = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 10).alias("mode"), F.array(at("o_orderkey"), at("o_custkey")).alias("descriptors"), F.array(F.lower("o_orderstatus")).alias("macros"), F.year("o_orderdate").alias("release_year")
    )
    found = temporal.compass(own, "mode")
    return found.select("mode", *[F.round(c, 9).alias(c) for c in (*AXES, "era")], "spread", "n")


@REGISTRY.add("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT floor((epoch_us(now) - epoch_us(ts)) / 604800000000)::BIGINT AS weeks, count(*) AS plays FROM events, m GROUP BY ALL""")
def recency_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays by weeks before the last one."""
    history = table(spark, sf_dir, "events").select("ts", F.lit(1).alias("plays"))
    return temporal.recency_curve(history, "plays", history.agg(F.max("ts").alias("now")).scalar())


@REGISTRY.add()
def listening_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions clustered into five modes by the mean of their events' vectors; tested on separate clusters."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_type").alias("item"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    known = events.select("item").distinct().select("item", F.array(*[(F.col("item") == k).cast("double") for k in kinds]).alias("vector"))
    return temporal.listening_modes(temporal.session_vectors(temporal.session_ids(events, "user_id"), "user_id", known), 5)


@REGISTRY.add(f"""WITH {CO_SQL}, a AS (SELECT DISTINCT p_brand AS name FROM part), cache AS (SELECT p_brand AS name, count(*) AS n FROM part WHERE p_size > 30 GROUP BY p_brand)
SELECT a.name, n FROM a LEFT JOIN cache USING (name)""")
def cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists with their cache entries; those without one stay."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "name")
    return part.select("name").distinct().join(part.where("p_size > 30").groupBy("name").agg(F.count("*").alias("n")), "name", "left")


@REGISTRY.add("SELECT vec_id AS node FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part WHERE p_size > 20)")
def library_in_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's names that are embedded."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"))
    return own.intersect(table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("node")))


@REGISTRY.add(f"""WITH {CO_SQL}, known AS (SELECT p_partkey AS node FROM part WHERE p_size > 25)
SELECT CASE WHEN src IN (SELECT node FROM known) THEN 'artist::' ELSE 'concept::' END || src AS src, CASE WHEN dst IN (SELECT node FROM known) THEN 'artist::' ELSE 'concept::' END || dst AS dst, weight FROM strong""")
def influence_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Influence edges whose ends are artists if the graph has them, else concepts."""
    known = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("node"), F.lit(True).alias("known"))
    out = strong(spark, sf_dir)
    for end in ("src", "dst"):
        out = out.join(known.withColumnsRenamed({"node": end, "known": f"{end}_known"}), end, "left")
    name = lambda end: layers.influence_endpoint(F.col(end).cast("string"), F.coalesce(f"{end}_known", F.lit(False))).alias(end)
    return out.select(name("src"), name("dst"), "weight")


@REGISTRY.add("""SELECT p_partkey AS node, sum(p_size) OVER (ORDER BY p_retailprice DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS before FROM part""")
def ordered_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums over one order of a whole table, range by range."""
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_retailprice", "p_size")
    found = order.summed_before(own, [F.desc("p_retailprice"), F.col("node")], F.col("p_size").cast("long"), "before")
    return found.select("node", F.when(F.col("before") != 0, F.col("before")).alias("before"))


CRAWL_ROUNDS = 30
CRAWL_SQL = f"""WITH {MATCH_SQL},
b0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS priority, 0 AS depth, node AS via FROM (VALUES (1::BIGINT), (2)) t(node)),
{", ".join(f'''b{k + 1} AS MATERIALIZED (SELECT node, -(b.p) AS priority, b.d AS depth, b.v AS via FROM (SELECT node, min(ROW(-priority, depth, via)::STRUCT(p DOUBLE, d INTEGER, v BIGINT)) AS b FROM (
    SELECT * FROM b{k} UNION ALL SELECT e.dst, b.priority * e.match, b.depth + 1, b.node FROM b{k} b JOIN directed e ON e.src = b.node) GROUP BY node))''' for k in range(CRAWL_ROUNDS))}
SELECT node, priority, depth, via FROM b{CRAWL_ROUNDS} ORDER BY priority DESC, node LIMIT 500"""


@REGISTRY.add(CRAWL_SQL)
def crawl_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl that is broken off after 100 nodes and resumed from its state: the same as a whole one."""
    folder = scratch(spark)
    seeds, edges = spark.range(1, 3).select(F.col("id").alias("node")), directed(spark, sf_dir)
    traversal.crawl(spark, seeds, edges, 100, folder)
    return traversal.crawl(spark, seeds, edges, 500, folder)


@REGISTRY.add(CRAWL_SQL)
def best_first_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole best-first crawl from two seeds, to 500 nodes, with depth and via (iterated to a fixpoint)."""
    return traversal.best_first(spark.range(1, 3).select(F.col("id").alias("node")), directed(spark, sf_dir), 500)


@REGISTRY.add("""WITH m AS (SELECT s_name AS k, s_nationkey AS n FROM supplier)
SELECT '{' || string_agg('"' || k || '":{"known":true,"nation":' || n || '}', ',' ORDER BY k) || '}' AS json FROM m""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table as one JSON object with sorted keys."""
    return files.json_map(table(spark, sf_dir, "supplier").select("s_name", F.col("s_nationkey").alias("nation"), F.lit(True).alias("known")), "s_name")


@REGISTRY.add("SELECT s_name AS name, regexp_replace(s_name, '[#0]', '', 'g') AS file FROM supplier")
def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file name under which an artist's note is found."""
    name = F.translate("s_name", "#0", ":?")
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), text.file_name(name).alias("file"))


COHERENCE_SQL = """WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
k AS (SELECT count(*) FILTER (label < 3) AS k, count(*) AS n FROM u),
members AS (SELECT 0 AS trial, vec_id FROM u WHERE label < 3 UNION ALL SELECT t, vec_id FROM (SELECT t, vec_id, row_number() OVER (PARTITION BY t ORDER BY md5(vec_id || ':' || t), vec_id) AS r FROM u, range(1, 21) x(t)), k WHERE r <= k),
cells AS (SELECT vec_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u),
whole AS (SELECT i, sum(x) AS x FROM cells GROUP BY i), part AS (SELECT trial, i, sum(x) AS x FROM members JOIN cells USING (vec_id) GROUP BY ALL),
sums AS (SELECT trial, list(p.x ORDER BY i) AS inner_sum, list(w.x - p.x ORDER BY i) AS outer_sum FROM part p JOIN whole w USING (i) GROUP BY trial),
p AS (SELECT s.trial, m.vec_id IS NOT NULL AS inside, list_dot_product(u, inner_sum) AS x, list_dot_product(u, outer_sum) AS y FROM u CROSS JOIN sums s LEFT JOIN members m ON m.trial = s.trial AND m.vec_id = u.vec_id),
d AS (SELECT trial, CASE WHEN inside THEN (k - x) / (k - 1) ELSE (n - k - y) / (n - k - 1) END AS a, CASE WHEN inside THEN 1 - y / (n - k) ELSE 1 - x / k END AS b FROM p, k),
t AS (SELECT trial, avg((b - a) / greatest(a, b)) AS s FROM d GROUP BY trial)
SELECT round(max(s) FILTER (trial = 0), 6) AS real, round(avg(s) FILTER (trial > 0), 6) AS mean, round(stddev_pop(s) FILTER (trial > 0), 6) AS sd,
max(s) FILTER (trial = 0) > avg(s) FILTER (trial > 0) + stddev_pop(s) FILTER (trial > 0) AS passed FROM t"""


@REGISTRY.add(COHERENCE_SQL)
def coherence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the library (labels 0 to 2) is more clustered than 20 random subsets of its size."""
    points = table(spark, sf_dir, "embeddings")
    home = points.where("label < 3").select(F.col("vec_id").alias("node"))
    found = evaluate.coherence(points, "vec_id", "embedding", home)
    return found.select(*[F.round(c, 6).alias(c) for c in ("real", "mean", "sd")], "passed")
