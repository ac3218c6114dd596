"""Queries over graph layers, joins, frontiers and traversals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.operators import frontier, layers, neighbour_index, traversal
from affinity.plans.registry import Registry, table

REGISTRY = Registry()
LEAST_LISTENING = 2200

PLAYS_SQL = """plays AS (SELECT l_suppkey AS who, p_type AS genre, p_brand AS brand, l_partkey AS item, l_orderkey AS o, l_quantity::BIGINT AS seconds
    FROM lineitem JOIN part ON p_partkey = l_partkey)"""
# Part-part co-orders of weight 2 and more: a sparse undirected graph.
CO_SQL = """own AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS m FROM lineitem),
co AS (SELECT a.m AS src, b.m AS dst, count(*) AS weight FROM own a JOIN own b ON a.g = b.g AND a.m < b.m GROUP BY ALL),
strong AS (SELECT * FROM co WHERE weight > 1)"""
# Directed matches: weight over the largest weight of the source, both ways.
MATCH_SQL = CO_SQL + """,
ways AS (SELECT src, dst, weight FROM strong UNION ALL SELECT dst, src, weight FROM strong),
directed AS (SELECT src, dst, weight / max(weight) OVER (PARTITION BY src)::DOUBLE AS match FROM ways)"""


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part: who, genre, brand, item, o, seconds."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_quantity")
    both = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return both.select(
        F.col("l_suppkey").alias("who"), F.col("p_type").alias("genre"), F.col("p_brand").alias("brand"),
        F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("o"), F.col("l_quantity").cast("long").alias("seconds"),
    )


def strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ordered together more than once: src, dst, weight."""
    return layers.pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey").where("weight > 1")


def directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same both ways with each source's match: src, dst, match."""
    edges = strong(spark, sf_dir)
    ways = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    top = ways.groupBy("src").agg(F.max("weight").alias("top"))
    return ways.join(top, "src").select("src", "dst", (F.col("weight") / F.col("top")).alias("match"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library: the parts of five brands: node."""
    return table(spark, sf_dir, "part").where("p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22')").select(F.col("p_partkey").alias("node"))


LIBRARY_SQL = "library AS (SELECT p_partkey AS node FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22'))"


@REGISTRY.add(f"""WITH {PLAYS_SQL},
e AS (SELECT who AS src, genre AS dst, sum(seconds)::BIGINT AS weight FROM plays WHERE seconds >= 1 GROUP BY ALL),
k AS (SELECT * FROM e WHERE weight >= {LEAST_LISTENING})
SELECT src, dst, 'listening' AS type, weight, weight / (SELECT max(weight) FROM k) AS norm_weight, weight * 100.0::DOUBLE / (SELECT sum(weight) FROM k) AS share
FROM k ORDER BY weight DESC, src, dst LIMIT 20""")
def listening_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest engagement edges after pruning, with normalised weight and share of all."""
    edges = layers.listening(plays(spark, sf_dir), "who", "genre", "seconds").withColumn("type", F.lit("listening"))
    edges = layers.share(layers.normalized(layers.pruned(edges, LEAST_LISTENING)), "weight")
    top = layers.ranked(edges, [F.desc("weight"), F.col("src"), F.col("dst")], 20)
    return top.select("src", "dst", "type", "weight", "norm_weight", "share")


@REGISTRY.add(f"""WITH {PLAYS_SQL}
SELECT who, sum(seconds)::BIGINT AS total_seconds, count(DISTINCT item) AS item_count, list_sort(list(DISTINCT genre)) AS genre_set, list_sort(list(DISTINCT brand)) AS brand_set
FROM plays GROUP BY who""")
def node_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and label sets of each node."""
    return layers.node_attributes(plays(spark, sf_dir), "who", "item", "seconds", "genre", "brand")


@REGISTRY.add(f"""WITH {PLAYS_SQL}, s AS (SELECT who, item, sum(seconds)::BIGINT AS seconds FROM plays GROUP BY ALL)
SELECT who, item AS top_item, seconds AS top_seconds FROM s QUALIFY row_number() OVER (PARTITION BY who ORDER BY seconds DESC, item) = 1""")
def top_item_per_artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's item of most seconds."""
    sums = plays(spark, sf_dir).groupBy("who", "item").agg(F.sum("seconds").alias("seconds"))
    return layers.top_item(sums, "who", "item", "seconds")


@REGISTRY.add(f"""WITH {PLAYS_SQL}, e AS (SELECT who AS src, genre AS dst, sum(seconds)::BIGINT AS weight FROM plays GROUP BY ALL)
SELECT src, dst, weight FROM e WHERE weight >= {LEAST_LISTENING}""")
def prune_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement edges at or above a weight."""
    edges = layers.listening(plays(spark, sf_dir), "who", "genre", "seconds").withColumn("type", F.lit("listening"))
    return layers.pruned(edges, LEAST_LISTENING).drop("type")


@REGISTRY.add(f"""WITH {PLAYS_SQL},
e AS (SELECT who::VARCHAR AS src, genre AS dst, 'genre' AS type, sum(seconds)::BIGINT AS weight FROM plays GROUP BY ALL
    UNION ALL SELECT who::VARCHAR, brand, 'brand', sum(seconds)::BIGINT FROM plays GROUP BY ALL)
SELECT src, dst, type, weight, weight / max(weight) OVER (PARTITION BY type) AS norm_weight FROM e""")
def normalize_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights over the largest of their type."""
    own = plays(spark, sf_dir)
    one = lambda c: layers.listening(own, "who", c, "seconds").select(F.col("src").cast("string").alias("src"), "dst", F.lit(c).alias("type"), "weight")
    return layers.normalized(one("genre").unionByName(one("brand"))).select("src", "dst", "type", "weight", "norm_weight")


@REGISTRY.add(f"""WITH {PLAYS_SQL}, s AS (SELECT genre, sum(seconds)::BIGINT AS seconds FROM plays GROUP BY genre)
SELECT genre, seconds, seconds * 100.0::DOUBLE / sum(seconds) OVER () AS share FROM s""")
def genre_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each genre's share of all seconds."""
    return layers.share(plays(spark, sf_dir).groupBy("genre").agg(F.sum("seconds").alias("seconds")), "seconds")


@REGISTRY.add("""WITH own AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS m FROM lineitem)
SELECT a.m AS src, b.m AS dst, count(*) AS weight FROM own a JOIN own b ON a.g = b.g AND a.m < b.m GROUP BY ALL""")
def collab_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of artists credited on one track, by the number of tracks."""
    return layers.pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@REGISTRY.add(f"""WITH {PLAYS_SQL}, own AS (SELECT DISTINCT brand AS g, who AS m FROM plays)
SELECT a.m AS src, b.m AS dst, count(*) AS weight FROM own a JOIN own b ON a.g = b.g AND a.m < b.m GROUP BY ALL""")
def production_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of artists who share producers, by the number of them."""
    return layers.pairs(plays(spark, sf_dir), "brand", "who")


@REGISTRY.add(f"""WITH {MATCH_SQL}, {LIBRARY_SQL}
SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(match) AS weight FROM directed d
WHERE match >= 0.5 AND src IN (SELECT node FROM library) AND dst IN (SELECT node FROM library) GROUP BY least(d.src, d.dst), greatest(d.src, d.dst)""")
def similarity_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches within the library at or above a floor."""
    return layers.similarity(directed(spark, sf_dir), library(spark, sf_dir), 0.5)


@REGISTRY.add(f"""WITH {CO_SQL}, curated AS (SELECT src, dst, 'curated' AS source FROM strong WHERE weight >= 3),
generated AS (SELECT dst AS src, src AS dst, 'generated' AS source FROM strong WHERE weight >= 2)
SELECT * FROM curated UNION ALL SELECT * FROM generated g WHERE NOT EXISTS
    (SELECT 1 FROM curated c WHERE least(c.src, c.dst) = least(g.src, g.dst) AND greatest(c.src, c.dst) = greatest(g.src, g.dst))""")
def influence_union_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated edges, and generated ones of other pairs."""
    edges = strong(spark, sf_dir)
    curated = edges.where("weight >= 3").select("src", "dst", F.lit("curated").alias("source"))
    return layers.influence(curated, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("generated").alias("source")))


@REGISTRY.add(f"""WITH {CO_SQL},
s AS (SELECT a.l_suppkey AS m, a.l_partkey AS g FROM lineitem a GROUP BY ALL),
e AS (SELECT src, dst, 'collab' AS type, weight::DOUBLE AS weight FROM co WHERE weight = 2
    UNION ALL SELECT src, dst, 'similarity', 0.5 FROM co WHERE weight IN (2, 3) UNION ALL SELECT src, dst, 'influence', 1.0 FROM co WHERE weight >= 4
    UNION ALL SELECT src, dst, 'production', weight FROM co WHERE weight IN (2, 4)),
k AS (SELECT src, dst, max((type = 'influence')::INT) AS i, max((type = 'collab')::INT) AS c, max((type = 'production')::INT) AS p, sum(weight) AS w FROM e GROUP BY ALL)
SELECT src, dst, CASE WHEN i = 1 THEN 'influence' WHEN c = 1 THEN 'collab' WHEN p = 1 THEN 'production' ELSE 'similarity' END AS type, CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE w END AS weight FROM k""")
def collapse_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers as one simple graph, by precedence."""
    co = layers.pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey").where("weight > 1")
    one = lambda where, kind, weight: co.where(where).select("src", "dst", F.lit(kind).alias("type"), F.expr(weight).cast("double").alias("weight"))
    edges = one("weight = 2", "collab", "weight").unionByName(one("weight IN (2, 3)", "similarity", "0.5")).unionByName(one("weight >= 4", "influence", "1"))
    edges = edges.unionByName(one("weight IN (2, 4)", "production", "weight"))
    return layers.collapse(edges).withColumn("weight", F.col("weight").cast("double"))


@REGISTRY.add(f"""WITH {MATCH_SQL} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(match) AS weight FROM directed d GROUP BY least(d.src, d.dst), greatest(d.src, d.dst)""")
def symmetrize_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges of the larger match."""
    return layers.symmetrized(directed(spark, sf_dir))


@REGISTRY.add(f"""WITH {MATCH_SQL} SELECT dst AS node, count(*) AS in_degree FROM directed WHERE match >= 0.9 GROUP BY dst""")
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each node is a strong target."""
    return layers.in_degree(directed(spark, sf_dir).where("match >= 0.9"))


@REGISTRY.add(f"""WITH {CO_SQL} SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT src FROM strong UNION SELECT dst FROM strong)""")
def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without a strong edge."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return layers.isolated(nodes, strong(spark, sf_dir))


@REGISTRY.add(f"""WITH {PLAYS_SQL}, t AS (SELECT DISTINCT who, genre FROM plays)
SELECT a.who AS src, b.who AS dst, count(*) AS weight FROM t a JOIN t b ON a.genre = b.genre AND a.who < b.who GROUP BY ALL""")
def bipartite_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists two hops apart through a shared tag."""
    return layers.pairs(plays(spark, sf_dir), "genre", "who")


@REGISTRY.add(f"""WITH {PLAYS_SQL}, own AS (SELECT DISTINCT o, genre FROM plays)
SELECT a.genre AS src, b.genre AS dst, count(*) AS weight FROM own a JOIN own b ON a.o = b.o AND a.genre < b.genre GROUP BY ALL""")
def genre_genre_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genres that meet on one track."""
    return layers.pairs(plays(spark, sf_dir), "o", "genre")


@REGISTRY.add(f"""WITH {PLAYS_SQL}, t AS (SELECT DISTINCT brand AS tag, genre FROM plays) SELECT tag, list_sort(list(genre)) AS nodes FROM t GROUP BY tag""")
def tag_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of each tag."""
    return layers.tag_index(plays(spark, sf_dir).select("brand", "genre").distinct(), "genre", "brand")


@REGISTRY.add(f"""WITH {CO_SQL} SELECT p.p_name AS src, coalesce(q.p_name, 'none') AS dst, s.weight FROM strong s JOIN part p ON p.p_partkey = s.src JOIN part q ON q.p_partkey = s.dst WHERE s.weight >= 3""")
def resolve_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by name instead of id."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    edges = strong(spark, sf_dir).where("weight >= 3").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight")
    return layers.resolved(edges, names)


@REGISTRY.add(f"""WITH {MATCH_SQL}, {LIBRARY_SQL},
loved AS (SELECT p_partkey AS node FROM part WHERE p_size >= 40)
SELECT dst AS node, round(sum(CASE WHEN src IN (SELECT node FROM loved) THEN match * 1.5::DOUBLE ELSE match END), 9) AS score, list_sort(list(DISTINCT src))[1:4] AS via
FROM directed WHERE src IN (SELECT node FROM library) AND dst NOT IN (SELECT node FROM library) GROUP BY dst ORDER BY score DESC, node LIMIT 20""")
def discovery_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies next to the library, by summed match."""
    loved = table(spark, sf_dir, "part").where("p_size >= 40").select(F.col("p_partkey").alias("node"))
    return frontier.discovery_frontier(directed(spark, sf_dir), library(spark, sf_dir), loved)


KNN_SQL = """v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings),
knn AS (SELECT a.vec_id AS id, b.vec_id AS other, array_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(c, 12) DESC, b.vec_id) <= {k}),
near AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY round(c, 12) DESC, other)::INTEGER AS rank FROM knn)"""
HOME_SQL = "home AS (SELECT vec_id AS node FROM embeddings WHERE label < 3)"


def home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors at home: those of labels 0 to 2."""
    return table(spark, sf_dir, "embeddings").where("label < 3").select(F.col("vec_id").alias("node"))


@REGISTRY.add(f"WITH {KNN_SQL.format(k=8)} SELECT id, other, rank FROM near")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 nearest others of every vector."""
    return frontier.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").drop("cosine")


@REGISTRY.add(f"WITH {KNN_SQL.format(k=8)} SELECT id, other, rank FROM near WHERE id % 100 = 0")
def knn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 nearest others of a hundredth of the vectors, by cells and angle bounds, exact."""
    points = table(spark, sf_dir, "embeddings")
    index = neighbour_index.CellIndex(points, "vec_id", "embedding")
    return index.nearest(points.where("vec_id % 100 = 0"), "vec_id").drop("cosine")


@REGISTRY.add()
def knn_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from as many cells as nine tenths of the neighbours take: true neighbours, those found, recall."""
    points = table(spark, sf_dir, "embeddings")
    index = neighbour_index.CellIndex(points, "vec_id", "embedding")
    asked = points.where("vec_id % 100 = 0")
    probes, _ = index.probes_for(0.95)
    pairs = lambda d: d.select("id", "other")
    true, found = pairs(index.nearest(asked, "vec_id")), pairs(index.nearest(asked, "vec_id", probes=probes))
    both = true.join(found.withColumn("hit", F.lit(1)), ["id", "other"], "left").agg(F.count("*").alias("neighbours"), F.count("hit").alias("found"))
    return both.withColumn("recall", F.col("found") / F.col("neighbours")).withColumn("probes", F.lit(probes)).withColumn("cells", F.lit(len(index.centres)))


@REGISTRY.add(f"""WITH {KNN_SQL.format(k=8)}, {HOME_SQL}
SELECT other AS node, count(DISTINCT id) AS sources, list_sort(list(DISTINCT id)) AS via FROM near
WHERE id IN (SELECT node FROM home) AND other NOT IN (SELECT node FROM home) GROUP BY other ORDER BY sources DESC, node LIMIT 20""")
def geometric_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that many of the home ones have near."""
    near = frontier.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return frontier.geometric_frontier(near, home(spark, sf_dir))


@REGISTRY.add(f"""WITH {KNN_SQL.format(k=20)}, n AS (SELECT vec_id FROM embeddings WHERE vec_id IN (1, 2, 3, 4))
SELECT a.vec_id AS id, b.vec_id AS other, rank FROM n a JOIN n b ON a.vec_id <> b.vec_id LEFT JOIN near ON near.id = a.vec_id AND near.other = b.vec_id""")
def mutual_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of four named vectors among one another's 20 nearest."""
    points = table(spark, sf_dir, "embeddings")
    named = points.where("vec_id IN (1, 2, 3, 4)").select("vec_id")
    near = frontier.nearest(points, "vec_id", "embedding", 20, named)
    return frontier.mutual_ranks(near, named.select(F.col("vec_id").alias("node")))


@REGISTRY.add("""SELECT p_partkey AS node, CASE WHEN lower(p_type) NOT IN ('economy', 'standard') THEN p_type WHEN lower(p_brand) NOT IN ('brand#11') THEN p_brand ELSE 'untagged' END AS primary_tag FROM part""")
def primary_tag_denylist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tag of each part that isn't denied."""
    from affinity.functions import text

    tags = F.array("p_type", "p_brand")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), text.primary_tag(tags, ["economy", "standard", "brand#11"]).alias("primary_tag"))


@REGISTRY.add("""WITH n AS (SELECT p_brand AS t FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 14)
SELECT p_partkey AS node, p_brand AS primary_tag, CASE WHEN p_brand IN (SELECT t FROM n) THEN p_brand ELSE 'other' END AS bucket FROM part""")
def top_tag_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by their tag if it is among the 14 most frequent, else other."""
    tagged = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.array("p_brand").alias("tags"))
    return frontier.tag_buckets(tagged, "tags").drop("tags")


@REGISTRY.add(f"""WITH {CO_SQL}, w AS (SELECT src, dst FROM strong UNION SELECT dst, src FROM strong),
h AS (SELECT 1::BIGINT AS node, 0 AS hops UNION ALL SELECT dst, 1 FROM w WHERE src = 1 UNION ALL SELECT b.dst, 2 FROM w a JOIN w b ON b.src = a.dst WHERE a.src = 1)
SELECT node, min(hops) AS hops FROM h GROUP BY node""")
def two_hop_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All within two hops of part 1."""
    start = spark.range(1, 2).select(F.col("id").alias("node"))
    return traversal.neighbourhood(strong(spark, sf_dir), start)


@REGISTRY.add(f"""WITH {CO_SQL}, s AS (SELECT src, dst, CASE WHEN weight >= 3 THEN 'close' ELSE '' END AS kind FROM strong)
SELECT DISTINCT node FROM (SELECT src AS node FROM s WHERE kind = 'close' UNION SELECT dst FROM s WHERE kind = 'close')""")
def property_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of edges with a property among values; empty ones never match."""
    edges = strong(spark, sf_dir).withColumn("kind", F.when(F.col("weight") >= 3, "close").otherwise(""))
    return traversal.edge_selection(edges, "kind", ["close", ""])


HIERARCHY_SQL = "h AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey // 2 >= 1)"


@REGISTRY.add(f"""WITH RECURSIVE {HIERARCHY_SQL},
walk(label, path, here) AS (SELECT p_partkey, [p_partkey], p_partkey FROM part
    UNION ALL SELECT label, list_append(path, parent), parent FROM walk JOIN h ON child = here WHERE len(path) <= 6 AND parent <> 3 AND NOT list_contains(path, parent))
SELECT label, arg_max(path, len(path)) AS path, arg_max(path, len(path))[-1] AS root FROM walk GROUP BY label""")
def walk_to_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's path up a hierarchy of halves, for six steps, stopping before part 3."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label"))
    parents = parts.select(F.col("label").alias("child"), F.lit(0).alias("pos"), F.expr("label div 2").alias("parent")).where("parent >= 1")
    return traversal.walk_to_root(parents, parts, [3])


@REGISTRY.add("""SELECT r_name, n_name, sum(c)::BIGINT AS customers FROM (SELECT r_name, n_name, count(*) AS c FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)
GROUP BY ROLLUP (r_name, n_name)""")
def genre_tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-level tree of sums with its inner nodes and root."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    own = counts.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return layers.rolled_up(own, "r_name", "n_name", "customers")


@REGISTRY.add(f"""WITH {MATCH_SQL},
b0 AS (SELECT node, 1.0::DOUBLE AS priority FROM (VALUES (1::BIGINT), (2)) t(node)),
{", ".join(f'''b{k + 1} AS (SELECT node, max(priority) AS priority FROM (SELECT * FROM b{k} UNION ALL SELECT d.dst, b.priority * d.match FROM b{k} b JOIN directed d ON d.src = b.node) GROUP BY node)''' for k in range(3))}
SELECT node, priority FROM b3 ORDER BY priority DESC, node LIMIT 100""")
def best_first_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 100 nodes within three hops of two seeds, by product of matches."""
    seeds = spark.range(1, 3).select(F.col("id").alias("node"))
    return traversal.reach(seeds, directed(spark, sf_dir), 3).orderBy(F.desc("priority"), "node").limit(100)


@REGISTRY.add(f"""WITH RECURSIVE {MATCH_SQL},
w(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT d.dst, w.depth + 1 FROM w JOIN directed d ON d.src = w.node WHERE w.depth < 3)
SELECT depth, count(*) AS nodes FROM (SELECT node, min(depth) AS depth FROM w GROUP BY node) GROUP BY depth""")
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes lie one, two and three hops from part 1."""
    start = spark.range(1, 2).select(F.col("id").alias("node"))
    around = traversal.neighbourhood(strong(spark, sf_dir), start, 3)
    return traversal.depth_histogram(around.withColumnRenamed("hops", "depth"))
