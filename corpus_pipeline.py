"""A training-data pipeline: five stages over ``documents``, each written as Parquet for the next.

Every stage works on all that its predecessor kept. The first three drop
documents, the fourth rewrites texts, the last turns them into tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm import bpe, decontam, neardup, pii, quality
from affinity.llm.common import materialize, table
from affinity.llm.queries import RANKS

#: Words a shingle and least similarity in percent; either links two documents.
NEAR = [(5, 80), (neardup.SHINGLE, neardup.PERCENT)]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or the log-likelihood ratio."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near-duplicates, alike in three words (0.85) or in five (0.8)."""
    return neardup.keep(docs, *NEAR[0], also=NEAR[1:])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of 13 words of the benchmark, or of which a twentieth stands in it."""
    return decontam.keep(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; ``n_chars`` follows the new text."""
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text and decode it again: counts and digests by document."""
    return bpe.digests(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", byte_level_bpe),
]

#: The boosted trees of the fourth stage have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
