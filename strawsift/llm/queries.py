"""The driver's queries over the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lines, lm, mixing, neardup, pii, quality, sharding, topk, unigram
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot and shard of every document, 64 shards over 65,537 slots."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, F.col("doc_id"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(table(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"), k=3, percent=85)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and best_score of every document."""
    return unigram.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed and text_sha256 of every document."""
    return lines.report(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_sharding": op1_sharding,
        "op2_topk": op2_topk,
        "op3_pii": op3_pii,
        "op4_minhash": op4_minhash,
        "op5_mixing": op5_mixing,
        "op6_token_counts": op6_token_counts,
        "op7_lm": op7_lm,
        "op8_line_dedup": op8_line_dedup,
        "op9_bpe": op9_bpe,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.oracle_sql()
