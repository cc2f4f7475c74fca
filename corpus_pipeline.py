"""The corpus pipeline: stages over documents, each written and read again.

quality    drops what the quality rules reject
near_dup   keeps one document of each group of near-duplicates (five words, 0.8)
private    replaces personal data by surrogates
mix        samples documents by weights raked to source, language and topic
pieces     encodes texts into SentencePiece ids, and decodes them again

All but the last return the columns of documents (n_chars follows the text), and other columns as they
are. Nulls, empty texts and tables, repeated rows: as the operators define; a null or empty text is dropped by
the first stage, of rows with equal doc_id and text one stays, a null doc_id is a document of its own. Tables between
stages are removed once the next is written.
No ORACLE_SQL: keyed surrogates and pieces are beyond SQL; the stages and the whole are
tested against plain Python instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import minhash, mixing, pieces, pii, quality_rules
from leadloom.llm.common import discard, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep(docs, minhash.NearDup(width=5))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.protect(docs, spans=None).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = pieces.read_model()
    out = pieces.decode(pieces.encode(docs.select("doc_id", "lang", "source", "text"), model), model)
    return out.select("doc_id", "lang", "source", "text", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [("quality", quality), ("near_dup", near_dup), ("private", private), ("mix", mix), ("pieces", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if n:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
