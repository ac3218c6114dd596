"""Queries over metrics, evaluation and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.operators import communities as louvain
from affinity.operators import embedding, evaluate, factors, frontier, layers, metrics, shortest, walks
from affinity.operators.session import cut
from affinity.plans.graph_queries import CO_SQL, plays, strong
from affinity.plans.registry import Registry, table

REGISTRY = Registry()
ENDS_SQL = f"{CO_SQL}, ends AS (SELECT src AS node FROM strong UNION ALL SELECT dst FROM strong)"
DRAW_SQL = "('0x' || substr(md5(src::VARCHAR || ':' || dst::VARCHAR || ':42'), 1, 8))::BIGINT"
ROUNDS = 5
SEEDS, NAMED = [42, 1], [1, 2, 3, 4]


@REGISTRY.add(f"""WITH {ENDS_SQL}, n AS (SELECT DISTINCT node FROM ends)
SELECT node, count(*) AS degree, count(*) / (SELECT count(*) - 1 FROM n) AS centrality FROM ends GROUP BY node""")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree over the number of other nodes."""
    edges = strong(spark, sf_dir)
    return metrics.degree_centrality(layers.endpoints(edges), edges)


@REGISTRY.add(f"""WITH {CO_SQL}, w AS (SELECT src, dst, weight FROM strong UNION ALL SELECT dst, src, weight FROM strong),
p AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src)::DOUBLE AS p FROM w), n AS (SELECT count(DISTINCT src) AS n FROM w),
r0 AS (SELECT DISTINCT src AS node, 1.0 / n AS rank FROM w, n),
{", ".join(f"r{k + 1} AS (SELECT p.dst AS node, 0.15 / any_value(n) + 0.85 * sum(p.p * r.rank) AS rank FROM p JOIN r{k} r ON r.node = p.src, n GROUP BY p.dst)" for k in range(ROUNDS))}
SELECT node, round(rank::DOUBLE, 9) AS rank FROM r{ROUNDS}""")
def pagerank_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rounds of weighted PageRank."""
    return metrics.pagerank(strong(spark, sf_dir), ROUNDS, None).withColumn("rank", F.round("rank", 9))


@REGISTRY.add(f"""WITH {ENDS_SQL}, d AS (SELECT node, count(*) AS degree FROM ends GROUP BY node) SELECT degree, count(*) AS nodes FROM d GROUP BY degree""")
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes have each degree."""
    return metrics.degree_histogram(strong(spark, sf_dir))


@REGISTRY.add(f"""WITH {ENDS_SQL}, d AS (SELECT node, count(*) AS degree FROM ends GROUP BY node),
t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM strong a JOIN strong b ON b.src = a.dst JOIN strong c ON c.src = a.src AND c.dst = b.dst),
n AS (SELECT node, count(*) AS triangles FROM (SELECT x AS node FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY node)
SELECT node, coalesce(triangles, 0) AS triangles, CASE WHEN degree > 1 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0.0::DOUBLE END AS coefficient FROM d LEFT JOIN n USING (node)""")
def clustering_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two neighbours of a node are neighbours too."""
    return metrics.clustering(strong(spark, sf_dir))


@REGISTRY.add(f"WITH {CO_SQL} SELECT src, dst, {DRAW_SQL} < {int(0.1 * 2**32)} AS held_out FROM strong")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the edges held out, by hash."""
    return evaluate.holdout(strong(spark, sf_dir)).select("src", "dst", "held_out")


def _hash_sql(*parts: str) -> str:
    return f"('0x' || substr(md5({" || ':' || ".join(parts)}), 1, 8))::BIGINT"


@REGISTRY.add(f"""WITH {CO_SQL}, e AS (SELECT src, dst, {DRAW_SQL} < {int(0.1 * 2**32)} AS held FROM strong),
d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e WHERE NOT held UNION ALL SELECT dst FROM e WHERE NOT held) GROUP BY node),
pos AS (SELECT src, dst FROM e WHERE held AND src IN (SELECT node FROM d) AND dst IN (SELECT node FROM d)), n AS (SELECT count(*) AS n FROM d),
placed AS (SELECT node AS other, {_hash_sql("node", "'place'", "42")} % n AS bucket FROM d, n), draws AS (SELECT node, {_hash_sql("node", "k", "42")} % n AS bucket FROM d, n, range(1, 5) r(k)),
apart AS (SELECT DISTINCT least(node, other) AS src, greatest(node, other) AS dst FROM draws JOIN placed USING (bucket) WHERE node <> other),
neg AS (SELECT * FROM apart a WHERE NOT EXISTS (SELECT 1 FROM strong s WHERE s.src = a.src AND s.dst = a.dst) ORDER BY md5(src || ':' || dst || ':42'), src, dst LIMIT (SELECT count(*) FROM pos)),
s AS (SELECT y, a.degree * b.degree AS score FROM (SELECT true AS y, * FROM pos UNION ALL SELECT false, * FROM neg) p JOIN d a ON a.node = p.src JOIN d b ON b.node = p.dst),
r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s)
SELECT (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0)::DOUBLE / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS auc, count(*) FILTER (y) AS n_positive, count(*) FILTER (NOT y) AS n_negative,
coalesce(auc >= 0.7, false) AS passed FROM r""")
def auc_pref_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well degrees in the training graph tell held-out edges from as many pairs without one."""
    edges = cut(strong(spark, sf_dir))
    train = evaluate.holdout(edges).where("NOT held_out")
    both = evaluate.held_out_pairs(edges, 0.1, 42)
    return evaluate.auc(evaluate.preferential_attachment(both, train), "score", "y")


@REGISTRY.add("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[64] AS e FROM embeddings),
c AS (SELECT a.vec_id, a.label, b.label AS other, sum(1 - array_cosine_similarity(a.e, b.e)) FILTER (a.vec_id <> b.vec_id) / count(*) FILTER (a.vec_id <> b.vec_id) AS d FROM v a, v b GROUP BY ALL),
s AS (SELECT vec_id, label, max(d) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM c GROUP BY ALL)
SELECT label, count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s GROUP BY label""")
def silhouette_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine silhouette of each label."""
    return evaluate.silhouette(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding").withColumn("silhouette", F.round("silhouette", 6))


@REGISTRY.add()
def seed_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many of two seeds' embeddings each of four named nodes is among another's 20 nearest."""
    runs = None
    for seed in SEEDS:
        points = _embedded(spark, sf_dir, seed).select(F.col("node").cast("long").alias("node"), "vector")
        named = points.where(F.col("node").isin(NAMED)).select("node")
        ranks = frontier.mutual_ranks(frontier.nearest(points, "node", "vector", 20, named), named)
        own = ranks.select(F.lit(seed).alias("seed"), "id", "other", F.col("rank").isNotNull().alias("hit"))
        runs = own if runs is None else runs.unionByName(own)
    return evaluate.consistency(runs)


#: Nodes from which shortest paths are followed: off by 0.085 at most, with a probability of 0.95.
PIVOTS = 256


@REGISTRY.add()
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness with weights as lengths, from pivots; tested against brute force with all nodes as pivots."""
    return shortest.betweenness(strong(spark, sf_dir), pivots=PIVOTS).withColumn("betweenness", F.round("betweenness", 9))


@REGISTRY.add()
def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance and effective diameter by sketches; tested against a search from every node."""
    found = shortest.path_lengths(shortest.distance_distribution(strong(spark, sf_dir)))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_distance", "effective_diameter")})


@REGISTRY.add()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Louvain communities; tested by modularity against the sequential algorithm."""
    return louvain.communities(strong(spark, sf_dir))


@REGISTRY.add(f"""WITH {CO_SQL}, w AS MATERIALIZED (SELECT src, dst, weight FROM strong UNION ALL SELECT dst, src, weight FROM strong),
l0 AS (SELECT DISTINCT src AS node, src AS community FROM w),
{", ".join(f"l{k + 1} AS MATERIALIZED (SELECT node, arg_min(community, (-s, community)) AS community FROM (SELECT w.src AS node, l.community, sum(weight)::BIGINT AS s FROM w JOIN l{k} l ON l.node = w.dst GROUP BY ALL) GROUP BY node)" for k in range(10))}
SELECT node, community FROM l10""")
def label_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities by label propagation, at any size."""
    return metrics.label_propagation(strong(spark, sf_dir))


@REGISTRY.add()
def power_law_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power-law fit of the degrees."""
    fit = metrics.power_law(metrics.degree_histogram(strong(spark, sf_dir)))
    return spark.createDataFrame([tuple(round(v, 6) for v in fit.values())], ", ".join(f"{k} double" for k in fit))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plays(spark, sf_dir).select(F.col("item").alias("node"), F.col("brand").alias("tag")).distinct()


@REGISTRY.add()
def walk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random walks over edges and tags."""
    return _walks(spark, sf_dir, SEEDS[0])


def _walks(spark: SparkSession, sf_dir: str, seed: int) -> DataFrame:
    edges = cut(strong(spark, sf_dir))
    return walks.walks(edges, _tagged(spark, sf_dir).join(layers.endpoints(edges), "node", "left_semi"), seed)


def _embedded(spark: SparkSession, sf_dir: str, seed: int) -> DataFrame:
    return embedding.node_vectors(embedding.skip_gram(_walks(spark, sf_dir, seed), seed))


@REGISTRY.add()
def embeddings_w2v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skip-gram vectors of the walks' nodes."""
    return _embedded(spark, sf_dir, SEEDS[0])


@REGISTRY.add()
def auc_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well walk vectors of the training graph tell held-out edges from drawn pairs, beside degrees; tested against a dense decomposition."""
    edges = cut(strong(spark, sf_dir))
    found = evaluate.link_prediction(edges, _tagged(spark, sf_dir).join(layers.endpoints(edges), "node", "left_semi"))
    return found.withColumns({c: F.round(c, 4) for c in ("auc_vectors", "auc_degrees")})


@REGISTRY.add()
def project_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors on their first two principal components."""
    return embedding.projected(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@REGISTRY.add()
def project_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors on the two slowest waves over their graph of 8 nearest; tested by the neighbours kept, against principal components."""
    near = frontier.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return factors.neighbour_projection(near).withColumn("at", F.transform("at", lambda x: F.round(x, 6)))
