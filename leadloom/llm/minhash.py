"""MinHash near-duplicates with min-max hashing.

Under each of `permutations` hash functions a set keeps both its smallest and its
largest value, so half the hash evaluations give a signature of twice the
length, whose agreement estimates the Jaccard similarity without bias and with
lower variance. Signatures are cut into bands; documents that share a band are
candidates. With 64 functions (128 values) in 32 bands of 4, a pair at exactly
0.8 is missed with probability (1 - 0.8^4)^32 < 5e-8.

Candidates are confirmed on the full sets of shingles (as sorted 64-bit hashes).
Equal sets are one class from the start, with a number of its own; links, buckets and
components are over classes, so any number of exact copies costs one node, and copies get
their class's component at the end. No bucket is expanded into all its pairs: in each
round every bucket compares its smallest class with those that aren't yet in the same
component, and drops it. A bucket ends as soon as its classes are connected. What
is still apart after `rounds` rounds is compared within its buckets as cells (cells.py): by sketches that
rule pairs out exactly, in tasks of bounded size, first each class with the nearest of every other component, then with
all. Only pairs that sketches can't rule out become rows, so no link between components is lost, and crowds of texts that
share most of their words without being linked make none.

Defined results: no words: set empty, linked with nothing; fewer words than a
shingle: the whole sequence is the one shingle; rows with the same doc_id are one
document, so it links the classes of all its texts; a null doc_id is a document of its own
without links; other columns are ignored; an empty table gives an empty result. keep()
leaves one row of rows with equal doc_id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import Cells, banded, bounded, candidates, sketch
from .common import checkpoint, discard, looked_up, small_batches, tasks_for, written
from .linking import components


@dataclass(frozen=True)
class NearDup:
    width: int = 5
    #: Documents are linked if 100 * intersection >= percent * union.
    percent: int = 80
    permutations: int = 64
    rows: int = 4
    rounds: int = 1
    seed: int = 20240229


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words; forgets them all when it holds many, and keeps no long ones."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 200_000:
                self.clear()
            self[word] = h
        return h


def shingles(text: str | None, width: int, known: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. Only A-Z are lower-cased,
    and words end at space and U+0009 to U+000D, as bytes.lower and bytes.split do."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, np.uint64(width))
    for j in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def _constants(p: NearDup) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    full = np.iinfo(np.uint64).max
    return rng.integers(0, full, p.permutations, np.uint64, endpoint=True) | np.uint64(1), rng.integers(0, full, p.permutations, np.uint64, endpoint=True)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest values under each function, then the largest ones."""
    low = high = None
    for at in range(0, len(hashes), 8192):
        x = hashes[at : at + 8192][None] * a[:, None]
        x += b[:, None]
        lo, hi = x.min(1), x.max(1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    return np.concatenate([low, high])


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    parts = sig.reshape(-1, rows)
    out = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for j in range(rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return out.view(np.int64)


def _set_key(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text that tells the rows of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def described(docs: DataFrame, p: NearDup) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (equal for equal sets, null for empty ones), bands."""
    a, b = _constants(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            sizes, keys, found = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), p.width, known)
                sizes.append(len(s))
                keys.append(_set_key(s))
                found.append(bands(signature(s, a, b), p.rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "set_key", "bands"])

    return _texts(small_batches(docs)).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>")


def _sets(docs: DataFrame, classes: DataFrame, p: NearDup) -> DataFrame:
    """node, hashes: the full sets of `classes` (node, set_key, doc_id, text_hash of one of its rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            found = [shingles(t.as_py(), p.width, known) for t in batch.column(1)]
            right = pa.array([_set_key(s) == k.as_py() for s, k in zip(found, batch.column(2), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(right), pa.array([s.tobytes() for s in found], pa.binary()).filter(right)], ["node", "hashes"])

    return _texts(docs).join(classes.select("node", "set_key", "doc_id", "text_hash"), ["doc_id", "text_hash"]).select("node", "text", "set_key").mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    of = lambda k: sets.select(F.col("node").alias(k), F.col("hashes").alias(f"hashes_{k}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "hashes_a", "hashes_b").mapInArrow(run, "a long, b long")


def _cells(p: NearDup) -> Cells:
    """Four bits a shingle tell sets apart that have half of their shingles in common."""
    return Cells(p.percent, bits=4)


def _in_cells(here: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """Cells of bounded size from the buckets of `here` (bucket, node, n_shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(np.frombuffer(h.as_buffer(), np.uint64), 4) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["node", "sketch"])

    rows = banded(here.select("bucket", "node", F.col("n_shingles").alias("n")), F.col("bucket"), _cells(p))
    sketches = sets.join(rows.select("node").distinct(), "node", "left_semi").select("node", "hashes").mapInArrow(run, "node long, sketch binary")
    return bounded(written(rows.join(sketches, "node")), _cells(p))


def _apart(here: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """Pairs (a < b) of classes in a common bucket but in different components that may still be similar enough."""
    labels = here.select("node", F.col("component").alias("label")).distinct()
    return candidates(_in_cells(here, sets, p).join(labels, "node"), _cells(p), "whole", tasks_for(here.sparkSession, 0))


def links_of(docs: DataFrame, classes: DataFrame, p: NearDup) -> DataFrame:
    """classes: node, set_key, doc_id, text_hash, n_shingles, bands. Confirmed links (a, b) that connect the classes as all links would."""
    spark = docs.sparkSession
    # A bucket's first class is that of the smallest doc_id: often the text that others were made from.
    all_rows = classes.select("node", "doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    shared = all_rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    rows = checkpoint(all_rows.join(shared, "bucket"))
    sets = checkpoint(_sets(docs, classes.join(rows.select("node").distinct(), "node", "left_semi"), p))
    none = spark.createDataFrame([], "a long, b long")
    links, tested, label = none, none, None
    near_in_size = lambda x, y: 100 * F.least(x, y) >= p.percent * F.greatest(x, y)  # noqa: E731  which no similar sets miss
    for turn in range(p.rounds + 1):
        if label is None:
            rows = rows.select("bucket", "node", "doc_id", "n_shingles", F.col("node").alias("component"))
        else:
            rows = rows.join(label, "node", "left").select("bucket", "node", "doc_id", "n_shingles", F.coalesce("component", "node").alias("component"))
        open_ = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "node", "component", "n_shingles")).alias("lead"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1")
        here = rows.join(open_.select("bucket", "lead"), "bucket")
        if turn:  # few rows are left
            here = checkpoint(here)
        if turn == p.rounds:
            break
        found = here.filter((F.col("component") != F.col("lead.component")) & near_in_size(F.col("n_shingles"), F.col("lead.n_shingles"))).select(F.least("lead.node", "node").alias("a"), F.greatest("lead.node", "node").alias("b"))
        pairs = checkpoint(found.distinct().join(tested, ["a", "b"], "left_anti"))
        links, tested = checkpoint(links.unionByName(_confirmed(pairs, sets, p.percent))), tested.unionByName(pairs)
        label = components(links)
        rows = here.filter(F.col("node") != F.col("lead.node")).select("bucket", "node", "doc_id", "n_shingles")
    if not here.limit(1).count():
        return links
    small = written(_in_cells(here, sets, p))
    tasks = tasks_for(spark, small.count() * 500)
    for mode in ("nearest", "whole"):
        label = components(links)
        apart = small.join(label, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        open_ = apart.groupBy("cell").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").select("cell")
        pairs = checkpoint(candidates(apart.join(open_, "cell"), _cells(p), mode, tasks).join(tested, ["a", "b"], "left_anti"))
        if not pairs.limit(1).count():
            continue  # all nearest ones may have been tested before; the next mode holds all others
        links, tested = checkpoint(links.unionByName(_confirmed(pairs, sets, p.percent))), tested.unionByName(pairs)
    discard(small)
    return links


def components_of(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of `docs`."""
    found = checkpoint(described(docs, p))
    with_set = found.filter(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    grouped = with_set.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    # Numbers are fixed by the checkpoint.
    classes = checkpoint(grouped.select(F.monotonically_increasing_id().alias("node"), "set_key", "one.doc_id", "one.text_hash", "n_shingles", "bands", "copies"))
    near = links_of(docs, classes, p)
    # Documents of several rows link the classes of their texts.
    several = with_set.groupBy("doc_id").agg(F.min("set_key").alias("first"), F.max("set_key").alias("last")).filter("first <> last")
    of = classes.select("set_key", "node")
    same = with_set.select("doc_id", "set_key").join(several, "doc_id").select("set_key", "first").distinct().join(of.withColumnRenamed("node", "a"), "set_key").join(of.select(F.col("set_key").alias("first"), F.col("node").alias("b")), "first").select("a", "b")
    label = components(near.unionByName(same))
    # A component is called after its smallest doc_id, over its classes.
    members = label.join(classes.select("node", "set_key", "doc_id"), "node")
    names = members.groupBy("component").agg(F.min("doc_id").alias("name"))
    linked = members.join(names, "component").select("set_key", "name")
    # Rows of each class; documents without links get their class's name, as other copies do.
    named = checkpoint(classes.select("set_key", "doc_id", "copies").join(linked, "set_key", "left").select("set_key", "copies", F.coalesce("name", "doc_id").alias("name")))
    out = looked_up(found.select("doc_id", "n_shingles", "set_key"), named, "set_key", "doc_id")
    id_ = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("name", "doc_id"))
    return out.select("doc_id", "n_shingles", id_.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """One document of each component (that with the smallest doc_id), with its columns; of
    rows with equal doc_id and text, one."""
    found = checkpoint(components_of(docs, p))
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g._gone"), "left_anti")
    twice = found.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_twice")).agg(F.count("*").alias("n")).filter("n > 1").select("_twice")
    if not twice.limit(1).count():
        return left
    again = F.col("d.doc_id") == F.col("t._twice")
    once = left.alias("d").join(twice.alias("t"), again, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.alias("d").join(twice.alias("t"), again, "left_anti").unionByName(once)
