"""Target-distribution importance resampling over hashed n-gram features.

Documents are weighed by how much likelier their features are in the target (here: the
texts of `benchmark`) than in the corpus, then drawn without replacement by Gumbel noise: of
the documents with `min_words` words or more, the `percent` with the highest scores.

Identical texts are collapsed first, by grouping on the full text: features and weight are computed
once for each distinct text, its counts are multiplied by the number of its copies, and the
weight is joined back to the documents by a SHA-256 of the text before each gets
noise of its own. A text with more than one in `hot` of all copies would be one join key with as many rows;
there are fewer than `hot` such texts, so their weights are broadcast.

What leaves a task is one row per feature bucket, already summed; the driver holds one gain per bucket. Places come
from a range partitioning by score and the sizes of its parts, so no window gathers all rows.

Defined results: a null text has no words; a null doc_id counts as an empty text in the
noise and comes last among ties; rows are weighed and drawn one by one, so a row that repeats
another's doc_id and text has its score, and gets a place of its own; other columns are
ignored; without documents the result is empty, without target texts all gains follow from
the smoothing alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, discard, looked_up, small_batches, tasks_for, written


@dataclass(frozen=True)
class Resampling:
    buckets: int = 10_000
    #: Longest run of words that is a feature.
    width: int = 3
    min_words: int = 20
    percent: int = 5
    seed: int = 42
    #: Texts with more than one in `hot` of the copies are joined by broadcast.
    hot: int = 1000


#: A-Z become a-z; bytes that belong to no word become spaces (all of a character beyond ASCII are from 0x80 on).
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def hashes(ws: list[bytes], width: int) -> list[int]:
    """CRC32 of each run of 1 to `width` words, joined by a space: that of a longer run goes on from the shorter one's."""
    crcs = list(map(zlib.crc32, ws))
    out, spaced = crcs[:], [b" " + w for w in ws]
    for n in range(1, width):
        crcs = list(map(zlib.crc32, spaced[n:], crcs))
        out += crcs
    return out


def _buckets(text: str | None, p: Resampling) -> tuple[int, np.ndarray]:
    ws = words(text)
    return len(ws), np.array(hashes(ws, p.width), np.int64) % p.buckets


def bucket_counts(texts: DataFrame, p: Resampling) -> np.ndarray:
    """Occurrences in each bucket over all of `texts` (text, copies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for batch in batches:
            for text, copies in zip(batch.column(0), batch.column(1), strict=True):
                total += np.bincount(_buckets(text.as_py(), p)[1], minlength=p.buckets) * copies.as_py()
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    sums = small_batches(texts).select("text", "copies").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(p.buckets, np.int64)
    for row in sums.collect():  # one row a bucket, `buckets` at most
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray, p: Resampling) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) for each bucket."""
    s_all, t_all = int(source.sum()) + p.buckets, int(target.sum()) + p.buckets
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(texts: DataFrame, gain: np.ndarray, p: Resampling) -> DataFrame:
    """digest, copies, n_words, n_features, weight of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_buckets(t.as_py(), p) for t in batch.column(0)]
            columns = [[n for n, _ in found], [len(b) for _, b in found], [int(gain[b].sum()) for _, b in found]]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), *[pa.array(c, pa.int64()) for c in columns]], ["digest", "copies", "n_words", "n_features", "weight"])

    return texts.select("text", "copies", _digest("text")).mapInArrow(run, "digest binary, copies long, n_words long, n_features long, weight long")


def _digest(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest")


def _grouped(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))


def scored(docs: DataFrame, target: DataFrame, p: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score; one row per row of `docs`."""
    texts = written(_grouped(docs))
    try:
        gain = gains(bucket_counts(texts, p), bucket_counts(_grouped(target), p), p)
        told = checkpoint(weights(texts, gain, p))
    finally:
        discard(texts)
    rows = looked_up(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest("text")), told, "digest", "doc_id", p.hot).drop("digest")
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), F.lit(8)), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise)


def drawn(docs: DataFrame, target: DataFrame, p: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_features, weight, score, rank; rank is null for documents that aren't drawn."""
    spark = docs.sparkSession
    rows = checkpoint(scored(docs, target, p).withColumn("fit", F.col("n_words") >= p.min_words))
    of = rows.agg(F.count("*").alias("n"), F.count_if("fit").alias("fit")).first()
    limit = p.percent * of.fit // 100
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id")]
    parted = rows.repartitionByRange(tasks_for(spark, of.n * 40), *order).sortWithinPartitions(*order)
    # A row's place is its partition's first place, and its number in the partition (the lower 33 bits of the id).
    placed = checkpoint(parted.withColumn("at", F.monotonically_increasing_id()))
    part, number = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    firsts, first = [], 0
    for row in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        firsts.append((row.part, first))
        first += row.n
    starts = F.broadcast(spark.createDataFrame(firsts, "part long, first long"))
    place = F.col("first") + number + 1
    rank = F.when(F.col("fit") & (place <= limit), place).alias("rank")
    return placed.withColumn("part", part).join(starts, "part").select("doc_id", "n_features", "weight", "score", rank)
