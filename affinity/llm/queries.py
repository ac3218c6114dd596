"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm import bpe, decontam, divergence, embedding_dedup, merkle, neardup, pii, quality, secret_scan, sharding, substring_fm, substring_sa, url_filter
from affinity.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"
SHARDS, VNODES = 8, 64


def op1_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document by the base rules and the log-likelihood ratio."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put every document into one of 8 shards whose counts differ by one at most."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), SHARDS, VNODES)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's component of near-duplicates."""
    return neardup.cluster(table(spark, sf_dir, "documents"))


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find secrets in every document and tell owner-specific ones from examples."""
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find personal data in every document."""
    return pii.digests(pii.detect(table(spark, sf_dir, "documents")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document by the 50k byte-level ranks."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op7_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page by the url rules, else by its host's trust and distrust."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find the benchmark's windows in every document."""
    return decontam.judge(decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove the 13-word windows of every document that an earlier one holds."""
    return substring_fm.digests(table(spark, sf_dir, "documents"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove the 100-byte strings of every document that start earlier."""
    return substring_sa.digests(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and roots, and the verdict on a copy with tampered rows."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each language's sources differ in their words."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_hnsw_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's links and component of near-duplicates."""
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


QUERIES = [op1_llr_quality, op2_bounded_ring, op3_minhash_dedup, op4_secret_ownership, op5_boosted_pii, op6_byte_bpe, op7_link_trust, op8_decontaminate, op9_fm_substrings, op10_suffix_array, op11_merkle_manifest, op12_source_divergence, op13_hnsw_embeddings]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to a function of the session and the folder of tables."""
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """The DuckDB SQL of the queries that SQL can express."""
    return {
        "op1_llr_quality": quality.judge_sql(),
        "op2_bounded_ring": sharding.shard_sql(SHARDS, VNODES),
        "op3_minhash_dedup": neardup.cluster_sql(),
        "op4_secret_ownership": secret_scan.scan_sql(),
        "op7_link_trust": url_filter.judge_sql(),
        "op8_decontaminate": decontam.judge_sql(),
        "op9_fm_substrings": substring_fm.digests_sql(),
        "op10_suffix_array": substring_sa.digests_sql(),
        "op11_merkle_manifest": merkle.manifest_sql(),
        "op12_source_divergence": divergence.audit_sql(),
        "op13_hnsw_embeddings": embedding_dedup.dedup_sql(),
    }
