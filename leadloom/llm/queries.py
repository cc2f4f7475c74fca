"""One query for each operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, divergence, langid, metricjoin, minhash, mixing, pieces, pii, quality_rules, resampling, sharding, suffixes, topk
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, F.col("vec_id") % 20 == 0)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model is of the BPE kind, so the forward state of a prefix is the last piece of its encoding."""
    return pieces.digest(table(spark, sf_dir, "documents"), pieces.read_model())


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda k: F.size(F.filter("entities", lambda e: e["kind"] == k))
    return pii.protect(docs).select("doc_id", F.size("entities").alias("n_entities"), *[count(k).alias(f"n_{k}") for k in pii.KINDS], F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "entities", "text")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components_of(table(spark, sf_dir, "documents"), minhash.NearDup(width=2))


def op9_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.fuzzy(table(spark, sf_dir, "documents"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(table(spark, sf_dir, "documents")).drop("spans")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metricjoin.components_of(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_langid, op4_sharding, op5_topk, op6_pieces, op7_pii, op8_minhash, op9_chaining, op10_suffixes, op11_jaccard_join, op12_divergence, op13_resampling)}
