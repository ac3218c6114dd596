"""Node embeddings: skip-gram vectors of walks, projection."""

from __future__ import annotations

from pyspark.ml.feature import PCA, Normalizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS, WINDOW, EPOCHS = 128, 5, 5


def skip_gram(corpus: DataFrame, seed: int = 42, size: int = DIMENSIONS, epochs: int = EPOCHS, partitions: int | None = None) -> DataFrame:
    """Skip-gram vectors of tokens: token, vector.

    Trained on as many partitions as there are threads unless stated; walks are
    dealt to them by hash. One partition in a fixed order gives the same vectors each time.
    """
    partitions = partitions or corpus.sparkSession.sparkContext.defaultParallelism
    shuffled = F.xxhash64("node", "walk", F.lit(seed))
    ordered = corpus.repartition(partitions, shuffled).sortWithinPartitions(shuffled, "node", "walk").select("tokens")
    model = Word2Vec(vectorSize=size, windowSize=WINDOW, minCount=1, maxIter=epochs, seed=seed, numPartitions=partitions, inputCol="tokens", outputCol="v").fit(ordered)
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vector"))


def node_vectors(vectors: DataFrame, prefix: str = "artist::") -> DataFrame:
    """The vectors of tokens with a prefix, without it: node, vector."""
    own = vectors.where(F.startswith("token", F.lit(prefix)))
    return own.select(F.substring("token", len(prefix) + 1, 1 << 20).alias("node"), "vector")


def projected(points: DataFrame, id: str, vector: str, k: int = 2) -> DataFrame:
    """Coordinates by the first principal components of the normalised vectors, a stand-in for a neighbour embedding."""
    own = points.select(id, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("raw"))
    unit = Normalizer(inputCol="raw", outputCol="unit").transform(own)
    model = PCA(k=k, inputCol="unit", outputCol="at").fit(unit)
    return model.transform(unit).select(id, vector_to_array("at").alias("at"))
