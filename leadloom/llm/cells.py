"""Cells of points that are joined exactly: split by pivots while they are large, then compared by sketches.

A point is a set of hashes. Linked are points whose Jaccard similarity is `percent` % or more, which is to say that their
symmetric difference H has at most (100 - percent) / (100 + percent) of the sum of their sizes. H is a metric, and
parity sketches (bit i is the parity of the elements whose hash is i) under the Hamming distance D are one that never exceeds
it. So D decides exactly what can't be linked, in a fraction of the bytes of the sets; what it leaves is to be confirmed.

Rows are (cell, size, node, n, home, sketch): a linked pair meets in a cell where one of the two is at home."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, tasks_for

COLUMNS = ["cell", "size", "node", "n", "home", "sketch"]


@dataclass(frozen=True)
class Cells:
    #: Points are linked if 100 * intersection >= percent * union.
    percent: int
    #: Points of a cell that one task joins.
    cap: int = 2000
    #: Pivots that a larger cell is split by, and how often.
    pivots: int = 16
    depth: int = 6
    #: Cells of no more points than this are compared at once, larger ones by centres first.
    few: int = 16
    #: Bits of a sketch for each element, at least: the lower the similarity, the more of them tell sets apart.
    bits: int = 1


def sketch(hashes: np.ndarray, bits: int = 1) -> bytes:
    """Parities over 2^j values, 64 at least and `bits` as many as elements."""
    m = max(64, 1 << (bits * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).tobytes()


def folded(sketches: list[bytes], least: int | None = None) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the length of the shortest, or to `least` bytes."""
    least = least or min(map(len, sketches))
    out = np.empty((len(sketches), least // 8), np.uint64)
    for i, s in enumerate(sketches):
        bits = np.frombuffer(s, np.uint64)
        out[i] = bits if len(s) == least else np.bitwise_xor.reduce(bits.reshape(-1, least // 8), 0)
    return out


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances of the rows of x to those of y (or to one)."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def _most(n: np.ndarray, m: np.ndarray | int, percent: int) -> np.ndarray:
    """The largest H of linked sets of these sizes."""
    return (100 - percent) * (n + m) // (100 + percent)


def sized(rows: DataFrame) -> DataFrame:
    """Rows with the size of their cell, but those of cells that can't hold a pair to compare."""
    sizes = rows.groupBy("cell").agg(F.count("*").alias("size"), F.count_if("home").alias("at_home")).filter("size > 1 and at_home > 0").drop("at_home")
    return rows.join(sizes, "cell")


def banded(rows: DataFrame, group: Column, p: Cells, parts: int | None = None) -> DataFrame:
    """cell, size, node, n, home of rows (group, node, n): a group's size bands. Points are at home in their own band and
    also go to the next one; bands are a hundredth wider than sizes of linked points can differ."""
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(101.0 / p.percent)))
    both = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band + 1).alias("band"), F.lit(False).alias("home")))).alias("x")
    return sized(checkpoint(rows.select(group.alias("g"), "node", "n", both).select(F.xxhash64("g", "x.band").alias("cell"), "node", "n", "x.home"), parts))


def _by_group(df: DataFrame, keys: list[str], order: list[str], body: Callable[[dict], Iterator[list]], schema: str, tasks: int) -> DataFrame:
    """Applies `body` to the columns (as lists) of each group, one at a time as a sorted partition streams by; groups are
    bounded by the caller. It yields lists of columns of `schema`."""
    kinds = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in schema.split(", "))])
    names, columns = kinds.names, df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = {c: [] for c in columns}, None
        done: list[list] = [[] for _ in names]

        def close() -> None:
            for out in body(held):
                for a, b in zip(done, out, strict=True):
                    a.extend(b)

        for batch in batches:
            rows = {c: batch.column(i).to_pylist() for i, c in enumerate(columns)}
            ids = list(zip(*[rows[k] for k in keys], strict=True))
            start = 0
            for i in range(len(ids) + 1):
                if i < len(ids) and ids[i] == current:
                    continue
                for c in columns:
                    held[c] += rows[c][start:i]
                if i < len(ids):
                    if current is not None:
                        close()
                    held, current, start = {c: [] for c in columns}, ids[i], i
            if len(done[0]) > 20_000:
                yield pa.RecordBatch.from_pydict(dict(zip(names, done, strict=True)), schema=kinds)
                done = [[] for _ in names]
        if current is not None:
            close()
        yield pa.RecordBatch.from_pydict(dict(zip(names, done, strict=True)), schema=kinds)

    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def split(large: DataFrame, turn: int, p: Cells) -> DataFrame:
    """Cells of more than `cap` points, by the Voronoi regions of `pivots` of them, with windows."""

    def body(rows: dict) -> Iterator[list]:
        of = folded(rows["sketch"], rows["least"][0])
        n = np.array(rows["n"])
        here = [i for i, k in enumerate(rows["is_pivot"]) if k]
        points = [i for i, k in enumerate(rows["is_pivot"]) if not k]
        if not points:
            return
        d = np.stack([apart(of[points], of[i]) for i in here], 1)
        near = d.argmin(1)
        # Partners have at most 100 / percent as many shingles.
        reaches = _most(n[points], 100 * n[points] // p.percent, p.percent)
        inside = d <= d[np.arange(len(points)), near][:, None] + 2 * reaches[:, None]
        for j, i in enumerate(here):
            take = np.flatnonzero(inside[:, j])
            chosen = [points[t] for t in take]
            yield [[rows["cell"][c] for c in chosen], [rows["size"][c] for c in chosen], [rows["node"][i]] * len(chosen), [rows["node"][c] for c in chosen], n[chosen].tolist(), [bool(rows["home"][c] and near[t] == j) for c, t in zip(chosen, take, strict=True)], [rows["sketch"][c] for c in chosen]]

    # All parts of a cell measure by the same folds, as windows compare distances of one part with those of another.
    large = large.join(large.groupBy("cell").agg(F.min(F.length("sketch")).alias("least")), "cell")
    parts = F.floor(F.col("size") / p.cap) + 1
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("node", F.lit(turn)), "node"))
    # A rank filter, so no cell is gathered.
    chosen = large.withColumn("place", place).filter(F.col("place") <= p.pivots).drop("place")
    pivots = chosen.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).withColumn("is_pivot", F.lit(True))
    points = large.withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), parts)).withColumn("is_pivot", F.lit(False))
    tasks = tasks_for(large.sparkSession, 0)
    out = _by_group(pivots.unionByName(points), ["cell", "part"], [], body, "parent long, before long, pivot long, node long, n long, home boolean, sketch binary", tasks)
    return out.withColumn("cell", F.xxhash64("parent", "pivot", F.lit(turn))).drop("pivot")


def in_blocks(stuck: DataFrame, p: Cells) -> DataFrame:
    """Cells that no pivots split, as cells of two blocks each."""
    parts = F.floor(2 * F.col("size") / p.cap) + 1
    rows = stuck.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("node", F.lit("block")), parts)})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return rows.select(F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), F.lit(p.cap).cast("long").alias("size"), "node", "n", "home", "sketch")


def bounded(now: DataFrame, p: Cells, parts: int | None = None) -> DataFrame:
    """The same points in cells of bounded size. now: a written table of rows. A cell that windows would more than double, or
    that a split hardly shrinks, has all its points about as far from each other: it is joined in blocks as it is."""
    done, large = now.filter(F.col("size") <= p.cap), now.filter(F.col("size") > p.cap)
    for turn in range(p.depth):
        if not large.limit(1).count():
            return done
        parted = checkpoint(split(large, turn, p), parts)
        blown = parted.groupBy("parent").agg(F.count("*").alias("rows"), F.first("before").alias("before")).filter("rows > 2 * before").select(F.col("parent").alias("cell"))
        done = done.unionByName(in_blocks(large.join(blown, "cell", "left_semi").select(*COLUMNS), p))
        parted = checkpoint(sized(parted.join(blown.withColumnRenamed("cell", "parent"), "parent", "left_anti")), parts)
        stuck = (F.col("size") > p.cap) & (F.col("size") * 4 > F.col("before") * 3)
        done = done.unionByName(parted.filter(F.col("size") <= p.cap).select(*COLUMNS)).unionByName(in_blocks(parted.filter(stuck).select(*COLUMNS), p))
        large = parted.filter((F.col("size") > p.cap) & ~stuck).select(*COLUMNS)
    return done.unionByName(in_blocks(large, p))


def candidates(small: DataFrame, p: Cells, mode: str, tasks: int) -> DataFrame:
    """Pairs (a < b) of rows with a `label` that sketches and sizes allow, one of them at home in the cell and with different
    labels. mode `whole`: all of them; `nearest`: for each point the nearest one of each label; `centres`: for each
    point one centre near it (cells of a few points: all), so pairs are no more than points.

    Crowds are to be linked by centres first, then by the nearest of other components, and as a whole last, each with the labels
    that the links so far give: then all links of two crowds are never made."""

    def body(rows: dict) -> Iterator[list]:
        if rows["label"].count(rows["label"][0]) == len(rows["label"]):
            return
        of, n, node = folded(rows["sketch"]), np.array(rows["n"]), np.array(rows["node"])
        home, label = np.array(rows["home"]), np.array(rows["label"])
        away = np.zeros(len(n), np.int64)
        a: list[int] = []
        b: list[int] = []

        def meet(i: int, others: np.ndarray) -> np.ndarray:
            fits = others[(100 * np.minimum(n[others], n[i]) >= p.percent * np.maximum(n[others], n[i])) & (home[others] | home[i]) & (label[others] != label[i])]
            if not len(fits):
                return fits
            away[fits] = apart(of[fits], of[i])
            fits = fits[away[fits] <= _most(n[fits], n[i], p.percent)]
            told = fits
            if mode == "nearest" and len(fits) > 1:
                order = np.argsort(away[fits], kind="stable")
                told = fits[order[np.unique(label[fits][order], return_index=True)[1]]]
            a.extend(np.minimum(node[told], node[i]).tolist())
            b.extend(np.maximum(node[told], node[i]).tolist())
            return fits

        if mode != "centres" or len(n) <= p.few:
            d = apart(of, of[0])
            order = np.argsort(d, kind="stable")
            # Whoever is linked with a point is no farther from or nearer to the pivot than the threshold.
            ends = np.searchsorted(d[order], d[order] + _most(n[order], int(n.max()), p.percent), "right")
            for at, (i, end) in enumerate(zip(order.tolist(), ends.tolist(), strict=True)):
                if end > at + 1:
                    meet(i, order[at + 1 : end])
        else:
            left = np.arange(len(n))
            while len(left) > 1:
                met = meet(int(left[0]), left[1:])
                left = left[1:][~np.isin(left[1:], met)]
        yield [a, b]

    return _by_group(small, ["cell"], ["node"], body, "a long, b long", tasks).distinct()
