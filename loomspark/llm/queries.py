"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, mixing, neardup, pii, secret_scan, substring, token_counts, topk, toxicity
from .common import Workspace, prepare, table
from .oracles import ORACLE as ORACLE


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), Workspace(spark))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"), Workspace(spark))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbours(table(spark, sf_dir, "documents"), Workspace(spark))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, Workspace(spark))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("piece_bpe_32k.model"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents"), Workspace(spark)))


# Columns of op1, op3 and op6 that SQL can express, each through its operator.


def personal_data_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def source_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), Workspace(spark))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighboured(table(spark, sf_dir, "documents"), Workspace(spark)).select("doc_id", "n_chars", "edited_sha256")


def _shipped(f):
    return lambda spark, sf_dir: f(prepare(spark), sf_dir)


QUERIES = {f.__name__: _shipped(f) for f in (op1_personal_data, op2_toxicity, op3_source_mix, op4_substring_dedup, op5_bpe_round_trip, op6_fingerprints, op7_exact_top_k, op8_near_dedup, op9_token_counts, op10_secret_scan, personal_data_patterns, source_mix_targets, edited_texts)}
