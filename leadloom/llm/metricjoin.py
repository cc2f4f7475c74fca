"""N-gram Jaccard join: an exact self-join of documents in a metric space.

Documents are points: sets of shingles, classes of equal sets being one point. Linked are points with a
Jaccard similarity of `percent` % or more, which is to say that their symmetric difference, a metric, is below a
share of the sum of their sizes. Cells of points are split and compared by sketches that give lower bounds of it (cells.py);
what they leave is confirmed on the full sets.

1. Pivots. Random documents are no pivots for a corpus: nearly all other documents are at the same
   distance from them, so windows would send each to every region. A document that has a link shares one of
   its first k = n - ceil(percent n / 100) + 1 shingles, in order of hashes, with it. These shingles are its anchors,
   and the smallest document at an anchor is the pivot of all that have it and whose size is near enough that of another
   there. Documents of one pivot are its region.
2. Crowded anchors (more than `crowd` documents: common lines, passages) are passed over: documents
   go on to the next shingles, up to 3 k of them, till they have k others. Two documents miss each other by
   this only if both have few other anchors, as texts that are mostly made of common parts; these, with
   all whose count is near enough for a link to one of them, meet at their crowded anchors as well (`keyed` has the bound).
3. Windows. Within a region, points go to their size band and the next one, as sizes of linked points differ by a
   band at most. A cell of more than `cap` points takes `pivots` of them: each point belongs to the nearest one's
   Voronoi region, and is replicated to every other whose pivot is no farther than that by twice
   the threshold (no linked pair can be farther apart, by the triangle inequality). Cells are split so again and again.
   Where all points are as far from each other, splitting ends and the cell is joined in pairs of blocks.
4. A small cell is joined by one task: points are sorted by the distance to the cell's pivot, each meets those in its window
   (the triangle inequality again), and pairs that D and the sizes allow are confirmed.

Crowds of near-copies make no pairs of all with all: larger cells first link every point to one centre near it; points that
the confirmed links leave in different components are then held against the nearest of each other component, and last
against all. So components are those of all links, but not every link is made.

Defined results: null or blank texts have the empty set and no links; texts with fewer words than a shingle
have their whole sequence as the one shingle; rows with the same doc_id are one document, so it links the
classes of all its texts; a null doc_id is a document of its own without links (component null); other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import Cells, banded, bounded, candidates, sketch
from .common import checkpoint, discard, looked_up, near, parts_for, shuffles_dropped, small_batches, tasks_for, written
from .linking import components, stars
from .minhash import _set_key, _texts, _Words, shingles


@dataclass(frozen=True)
class MetricJoin:
    width: int = 3
    #: Documents are linked if 100 * intersection >= percent * union.
    percent: int = 90
    #: Documents that may share an anchor for it to be used by all.
    crowd: int = 64
    cells: Cells = field(default_factory=lambda: Cells(90))

    def __post_init__(self) -> None:
        if self.cells.percent != self.percent:
            raise ValueError("cells are of another similarity")


def reach(n, percent: int):
    """k: how many first shingles of a set of n must hold one that is shared; n - ceil(percent n / 100) + 1."""
    return n - (percent * n + 99) // 100 + 1


def described(docs: DataFrame, p: MetricJoin) -> DataFrame:
    """row (a number of its own), doc_id, text_hash, n_shingles, set_key, low (the first 3 k hashes), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            sizes, keys, lows, bits = [], [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py(), p.width, known)
                sizes.append(len(s))
                keys.append(_set_key(s))
                lows.append(s[: 3 * reach(len(s), p.percent)].view(np.int64) if len(s) else None)
                bits.append(sketch(s) if len(s) else None)
            told = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(lows, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *told], ["row", "doc_id", "text_hash", "n_shingles", "set_key", "low", "sketch"])

    rows = small_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "row long, doc_id long, text_hash long, n_shingles long, set_key binary, low array<long>, sketch binary")


def keyed(lows: DataFrame, p: MetricJoin, parts: int | None = None) -> DataFrame:
    """node, n, anchors, common: the first k anchors that aren't crowded, and the crowded ones among the first k where
    these are needed, too.

    Let y have fewer than k_y free anchors among its first 3 k_y shingles. Of these, x has all but k_y - 1 if the two are linked,
    so at least 2 k_y + 1 shingles of x come no later than y's last. If the first 2 k_y + 1 of x hold k_x free ones, y has one of these, as
    x has k_x - 1 shingles at most that y lacks; and y uses all free ones it has. k_y is no less than that of a set with percent
    of the shingles of x. So only x that have fewer may need crowded anchors, and for two such
    the first k shingles of either, crowded or not, hold one of the other."""
    k, n = F.col("k"), F.col("n")
    ceil = lambda x: F.floor((p.percent * x + 99) / 100)
    lows = lows.withColumn("k", n - ceil(n) + 1)
    first = lows.select("node", F.explode(F.slice("low", F.lit(1), k.cast("int"))).alias("s"))
    # Shingles of one set alone can't be crowded.
    shared = checkpoint(first.groupBy("s").agg(F.count("*").alias("c")).filter("c > 1"), parts)
    crowded = checkpoint(shared.filter(F.col("c") > p.crowd).select("s"), parts)
    hit = checkpoint(first.join(near(crowded, crowded.count()), "s").select("node").distinct(), parts)
    # Once more, with the shingles that those documents go on to. Any set of crowded shingles gives right results, so one that
    # is crowded by the last documents alone may pass; it only makes a larger region.
    more = lows.join(near(hit, hit.count()), "node").select("node", F.explode(F.slice("low", k.cast("int") + 1, F.size("low"))).alias("s"))
    counts = shared.unionByName(more.groupBy("s").agg(F.count("*").alias("c"))).groupBy("s").agg(F.sum("c").alias("c"))
    crowded = checkpoint(counts.filter(F.col("c") > p.crowd).select("s"), parts)
    at_hand = near(crowded, crowded.count())
    hit = checkpoint(first.join(at_hand, "s").select("node").distinct(), parts)
    touched = near(hit, hit.count())
    held = lows.join(touched, "node").select("node", F.explode("low").alias("s")).join(at_hand, "s").groupBy("node").agg(F.collect_list("s").alias("held"))
    none = F.array().cast("array<long>")
    told = lows.join(touched, "node", "left_anti").withColumn("held", none).unionByName(lows.join(touched, "node", "left_semi").join(held, "node").withColumn("held", F.coalesce("held", none)))
    free = F.when(F.size("held") == 0, F.slice("low", F.lit(1), k.cast("int"))).otherwise(F.slice(F.array_except("low", "held"), F.lit(1), k.cast("int")))
    least = ceil(n)
    window = (2 * (least - ceil(least) + 1) + 1).cast("int")
    poor = (F.size("held") > 0) & (F.size(F.array_except(F.slice("low", F.lit(1), window), "held")) < k)
    common = F.when(poor, F.array_intersect(F.slice("low", F.lit(1), k.cast("int")), "held"))
    return told.select("node", "n", free.alias("anchors"), common.alias("common"))


def regions(lows: DataFrame, p: MetricJoin, parts: int | None = None) -> DataFrame:
    """pivot, node, n: documents that share an anchor are in the region of the smallest one that has it, unless
    none there is near enough to them in size."""
    found = checkpoint(keyed(lows, p, parts), parts)
    at, by_size = Window.partitionBy("s"), Window.partitionBy("s").orderBy("n")
    fits = lambda small, large: F.coalesce(100 * small >= p.percent * large, F.lit(False))
    near = fits(F.lag("n").over(by_size), F.col("n")) | fits(F.col("n"), F.lead("n").over(by_size))
    free = found.select("node", "n", F.explode("anchors").alias("s")).select("node", "n", F.min("node").over(at).alias("pivot"), near.alias("near"))
    common = found.filter(F.size("common") > 0).select("node", "n", F.explode("common").alias("s"))
    leads = common.groupBy("s").agg(F.min("node").alias("pivot"), F.count("*").alias("c")).filter("c > 1")
    return free.filter("near").select("pivot", "node", "n").unionByName(common.join(leads, "s").select("pivot", "node", "n")).distinct()


def confirmed(docs: DataFrame, pairs: DataFrame, classes: DataFrame, p: MetricJoin, most: int | None = None) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Each a is sent to the tasks of its pairs, once, and each b to that
    of a pair; a's pairs are dealt into parts of 500, and a task holds one set at a time beside the one it reads. Tables have no
    more than `most` partitions."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            found = [shingles(t.as_py(), p.width, known) for t in batch.column(3)]
            right = pa.array([_set_key(s) == k.as_py() for s, k in zip(found, batch.column(4), strict=True)], pa.bool_())
            columns = [*batch.columns[:3], pa.array([s.tobytes() for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([c.filter(right) for c in columns], ["a", "part", "b", "hashes"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, np.empty(0, np.uint64)
        for batch in batches:
            keep: list[tuple[int, int]] = []
            for a, part, b, h in zip(*[c.to_pylist() for c in batch.columns[:3]], batch.column(3), strict=True):
                other = np.frombuffer(h.as_buffer(), np.uint64)
                if b == a:
                    key, own = (a, part), other.copy()
                elif key == (a, part):
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= p.percent * (len(own) + len(other) - both):
                        keep.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keep], pa.int64()), pa.array([y for _, y in keep], pa.int64())], ["a", "b"])

    parts = pairs.groupBy("a").agg((F.floor(F.count("*") / 500) + 1).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    ends = dealt.unionByName(dealt.select("a", "part", F.col("a").alias("b")).distinct())
    wanted = checkpoint(ends.join(classes.select(F.col("node").alias("b"), "set_key", "doc_id", "text_hash"), "b"), most)
    n = wanted.count()
    sets = _texts(small_batches(docs)).join(near(wanted, n), ["doc_id", "text_hash"]).select("a", "part", "b", "text", "set_key").mapInArrow(hashed, "a long, part long, b long, hashes binary")
    # Of a and its partners a comes first, as they are larger.
    dealt_out = sets.repartition(tasks_for(docs.sparkSession, n * 5000), "a", "part").sortWithinPartitions("a", "part", "b")
    return checkpoint(dealt_out.mapInArrow(compared, "a long, b long"), most)


def links_of(docs: DataFrame, classes: DataFrame, lows: DataFrame, p: MetricJoin, parts: int | None = None) -> DataFrame:
    """(node, component) of the classes that have confirmed links, as all links would connect them."""
    spark = docs.sparkSession
    rows = banded(regions(lows, p, parts), F.col("pivot"), p.cells, parts)
    small = written(bounded(written(rows.join(lows.select("node", "sketch"), "node")), p.cells, parts))
    tasks = tasks_for(spark, small.count() * 300)
    tested = checkpoint(candidates(small.withColumn("label", F.col("node")), p.cells, "centres", tasks), parts)
    label = components(confirmed(docs, tested, classes, p, parts), parts)
    crowds = small.filter(F.col("size") > p.cells.few)
    for mode in ("nearest", "whole"):
        # Cells of one label make no pairs.
        apart = crowds.join(near(label, label.count()), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        found = checkpoint(candidates(apart, p.cells, mode, tasks).join(tested, ["a", "b"], "left_anti"), parts)
        if not found.limit(1).count():
            continue  # all nearest ones may have been tested in other cells; the next mode holds all others
        # A component is a star: its nodes and the smallest.
        more = confirmed(docs, found, classes, p, parts)
        if more.limit(1).count():
            label = components(stars(label).unionByName(more), parts)
        tested = tested.unionByName(found)
    discard(small)
    return label


def components_of(docs: DataFrame, p: MetricJoin = MetricJoin()) -> DataFrame:
    """doc_id, n_shingles, component_id; one row per row of `docs`."""
    with shuffles_dropped(docs.sparkSession):
        found, named = _named(docs, p)
    out = looked_up(found.select("row", "doc_id", "n_shingles", "set_key"), named, "set_key", "row")
    component: Column = F.when(F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def _named(docs: DataFrame, p: MetricJoin) -> tuple[DataFrame, DataFrame]:
    """The rows with their set_key; and set_key, copies, name of its component."""
    wide = written(described(docs, p))
    found = checkpoint(wide.drop("low", "sketch"))
    parts = parts_for(docs.sparkSession, found.count())
    with_set = found.filter(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    one = F.min(F.struct("doc_id", "row", "text_hash")).alias("one")
    grouped = with_set.groupBy("set_key").agg(one, F.first("n_shingles").alias("n"), F.count("*").alias("copies"))
    classes = checkpoint(grouped.select(F.col("one.row").alias("node"), "set_key", "one.doc_id", "one.text_hash", "n", "copies"), parts)
    n = classes.count()
    lows = written(wide.select(F.col("row").alias("node"), "low", "sketch").join(near(classes.select("node", "n"), n), "node"))
    discard(wide)
    label = links_of(docs, near(classes, n, 100_000), lows, p, parts)
    discard(lows)
    # Documents of several rows link the classes of their texts.
    several = with_set.groupBy("doc_id").agg(F.min("set_key").alias("first"), F.max("set_key").alias("last")).filter("first <> last")
    of = classes.select("set_key", "node")
    same = with_set.select("doc_id", "set_key").join(several, "doc_id").select("set_key", "first").distinct().join(of.withColumnRenamed("node", "a"), "set_key").join(of.select(F.col("set_key").alias("first"), F.col("node").alias("b")), "first").select("a", "b")
    if several.limit(1).count():
        label = components(stars(label).unionByName(same), parts)
    # A component is called after its smallest doc_id, over its classes.
    members = label.join(classes.select("node", "set_key", "doc_id"), "node")
    names = members.groupBy("component").agg(F.min("doc_id").alias("name"))
    linked = members.join(names, "component").select("set_key", "name")
    return found, checkpoint(classes.select("set_key", "doc_id", "copies").join(linked, "set_key", "left").select("set_key", "copies", F.coalesce("name", "doc_id").alias("name")), parts)
