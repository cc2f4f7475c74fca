"""Exact top-k search by inner product with pivot-table elimination.

Vectors are integers, so scores are exact. An inner product becomes a distance
once every candidate gets one more component, sqrt(M - |x|^2), where M is the
largest squared norm: |q - x|^2 = |q|^2 + M - 2 q.x. The distances of all candidates to the
pivots are computed once, and travel with their blocks; |d(q, p) - d(x, p)| over all pivots p
gives the largest lower bound of d(q, x), hence an upper bound of the score. A
query looks at candidates from the highest bound down and stops once its k-th
score is above every bound that is left. Ties are kept until they are decided.

Every query begins with a threshold that all blocks share: its k-th score among the rows of a
first block (a fixed number, by hash). A block whose distances to some pivot are all
too far from the query's is passed over; of the others only candidates whose bound reaches the
threshold are sorted and evaluated.

A query set (not a row limit: the rows that `is_query` names) runs against all
rows in blocks. Vectors are packed into blocks of bounded size; each block of
candidates meets each block of queries once, in a task of bounded memory; the k
best of each meeting are merged per query by a rank over k rows for each block.

Defined results: vectors that are null or hold null or non-finite components
take no part; a shorter vector counts as one with zeros at its end, so an empty one scores 0
with all; components and scores beyond 64 bits become the largest or smallest long;
repeated rows are candidates one by one; rows of one query id are one query, whose list is the
k best of all their pairs; a query's own id is no candidate; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

_LONG = (-(1 << 63), (1 << 63) - 1)


@dataclass(frozen=True)
class Search:
    k: int = 20
    pivots: int = 16
    #: Vectors in a block of queries, and in a block of candidates, and bytes of either at most.
    query_block: int = 4096
    block: int = 8192
    block_bytes: int = 16 << 20
    #: Rows that give every query its first threshold.
    first: int = 2048
    #: Candidates that a query evaluates at first, in bound order; then twice as many, and so on.
    step: int = 256


def quantised(df: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and v = floor(scale * x) as array<long> (components beyond 64 bits become the largest or
    smallest long), without the vectors that take no part."""
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    rows = df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~bad)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of longs, with zeros behind short ones."""
    out = np.zeros((len(vectors), width), "<i8")
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


class Table:
    """Vectors and the pivots they are measured against."""

    def __init__(self, pivots: np.ndarray, largest: float):
        self.largest = largest
        self.width = pivots.shape[1]
        self.points = pivots.astype("f8")
        self.lift = np.sqrt(np.maximum(0.0, largest - (self.points**2).sum(1)))
        # Sums of products stay below `largest`, so so many bits hold them exactly.
        self.kind = "f4" if largest < 2**24 else "f8" if largest < 2**52 else "i8" if largest < 2**62 else object

    def apart(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        """Distances to the pivots, one row for each pivot."""
        x = x.astype("f8")
        norms = (x * x).sum(1)
        lift = np.sqrt(np.maximum(0.0, self.largest - norms)) if lifted else np.zeros(len(x))
        own = (self.points**2).sum(1) + self.lift**2
        return np.sqrt(np.maximum(0.0, (norms + lift**2)[None] + own[:, None] - 2 * (self.points @ x.T + np.outer(self.lift, lift)))).astype("f4")

    def scores(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = x.astype(self.kind) @ q.astype(self.kind)
        return np.clip(out, *_LONG).astype("i8") if self.kind is object else out.astype("i8")

    def best(self, query_ids, queries, least, ids, vecs, d_x, k: int, step: int):
        """The k best of one block of candidates (sorted by id) for each query of one block, but for those
        below the queries' thresholds `least`."""
        d_q, norms = self.apart(queries, False), (queries.astype("f8") ** 2).sum(1)
        x, q = vecs.astype(self.kind), queries.astype(self.kind)
        # Of a bound, (|q|^2 + M - low^2) / 2, single precision may be off by this much.
        slack = 0.5 + 1e-5 * self.largest
        near, far = d_x.min(1), d_x.max(1)
        out = []
        low, one = np.empty(len(x), "f4"), np.empty(len(x), "f4")
        for i in range(len(q)):
            floor = float(least[i])
            # A score of `floor` needs a distance within this.
            within = np.sqrt(max(0.0, norms[i] + self.largest - 2 * (floor - slack)))
            apart = float(np.maximum(near - d_q[:, i], d_q[:, i] - far).max())
            if apart > within * (1 + 1e-6):
                continue
            low[:] = 0
            for a, b in zip(d_x, d_q[:, i], strict=True):
                np.subtract(a, b, out=one)
                np.abs(one, out=one)
                np.maximum(low, one, out=low)
            low[ids == query_ids[i]] = np.inf
            alive = np.flatnonzero(low <= within * (1 + 1e-6))
            by = alive[np.argsort(low[alive], kind="stable")]
            bound = (norms[i] + self.largest - np.square(low[by], dtype="f8")) / 2 + slack
            scores, found = np.empty(0, "i8"), np.empty(0, "i8")
            at, size, end = 0, step, len(by)
            while at < end:
                part = by[at : min(at + size, end)]
                here = x[part] @ q[i]
                here = np.clip(here, *_LONG).astype("i8") if self.kind is object else here.astype("i8")
                better = here >= (max(scores[-1], least[i]) if len(scores) == k else least[i])
                scores, found = np.concatenate([scores, here[better]]), np.concatenate([found, ids[part[better]]])
                top = np.lexsort((found, -scores))[:k] if self.kind is not object else np.array(sorted(range(len(scores)), key=lambda n: (-int(scores[n]), int(found[n])))[:k], int)
                scores, found = scores[top], found[top]
                at, size = at + size, 2 * size
                if len(scores) == k:  # no bound further on reaches the k-th score
                    end = min(end, int(np.searchsorted(-bound, -float(scores[-1]), "right")))
            out.append((np.full(len(scores), query_ids[i]), found, scores))
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, "i8")] * 3


def _packed(rows: DataFrame, size: int, table: Table) -> DataFrame:
    """Blocks of up to `size` rows in the order of their ids, with their rows of the pivot table; no shuffle."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vs = [], []

        def out():
            order = np.argsort(np.array(ids, "<i8"), kind="stable")
            x = _matrix(vs, table.width)[order]
            return pd.DataFrame({"ids": [np.array(ids, "<i8")[order].tobytes()], "vecs": [_narrow(x)], "far": [table.apart(x, True).tobytes()]})

        for b in batches:
            for i, v in zip(b["vec_id"], b["v"], strict=True):
                ids.append(i)
                vs.append(v)
                if len(ids) == size:
                    yield out()
                    ids, vs = [], []
        if ids:
            yield out()

    return rows.mapInPandas(pack, "ids binary, vecs binary, far binary")


def _narrow(x: np.ndarray) -> bytes:
    """Bytes of a matrix in the fewest bytes a number, which come first."""
    kind = next(k for k in ("<i2", "<i4", "<i8") if not x.size or (x.min() >= np.iinfo(k).min and x.max() <= np.iinfo(k).max))
    return kind[-1].encode() + x.astype(kind).tobytes()


def _wide(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[:1].decode()}", offset=1).reshape(-1, width) if width else np.zeros((0, 0), "<i8")


def top_k(rows: DataFrame, is_query: Column, search: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id, score. `rows` as from quantised()."""
    rows = checkpoint(rows)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most, width = rows.agg(F.max(square), F.max(F.size("v"))).first()
    if most is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, k, step = max(1, width), search.k, search.step
    # Pivots: a fixed number of rows by hash, and the one with the largest norm.
    by_hash = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v")
    some = [r["v"] for r in by_hash.limit(search.pivots - 1).collect()] + [r["v"] for r in rows.orderBy(square.desc(), "vec_id", "v").limit(1).collect()]
    table = Table(_matrix(some, width), float(most))
    fit = max(1, search.block_bytes // (8 * width))
    head = by_hash.limit(min(search.first, fit)).collect()
    first_ids, first = np.array([r["vec_id"] for r in head], "i8"), _matrix([r["v"] for r in head], width)

    asking = rows.filter(is_query)
    parts = asking.count() // min(search.query_block, fit) + 1

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, q = pdf["vec_id"].to_numpy("<i8"), _matrix(pdf["v"].tolist(), width)
        least = np.full(len(q), _LONG[0], "<i8")
        for i, row in enumerate(q):
            known = np.sort(table.scores(first, row)[first_ids != ids[i]])
            if len(known) >= k:
                least[i] = known[-k]
        return pd.DataFrame({"qb": [pdf["qb"].iloc[0]], "q_ids": [ids.tobytes()], "q_vecs": [_narrow(q)], "least": [least.tobytes()]})

    # Every block of candidates goes to every block of queries, by an equi-join on the queries' block number.
    queries = asking.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(parts))).groupBy("qb").applyInPandas(gather, "qb long, q_ids binary, q_vecs binary, least binary")
    blocks = _packed(rows, min(search.block, fit), table).withColumnsRenamed({"ids": "c_ids", "vecs": "c_vecs"})
    sent = blocks.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    met = sent.join(queries, "qb")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c_ids, c_vecs, far, q_ids, q_vecs, least in zip(b["c_ids"], b["c_vecs"], b["far"], b["q_ids"], b["q_vecs"], b["least"], strict=True):
                ids = np.frombuffer(c_ids, "<i8")
                a, i, s = table.best(np.frombuffer(q_ids, "<i8"), _wide(q_vecs, width), np.frombuffer(least, "<i8"), ids, _wide(c_vecs, width), np.frombuffer(far, "<f4").reshape(-1, len(ids)), k, step)
                yield pd.DataFrame({"query_id": a, "vec_id": i, "score": s})

    met = met.repartition(F.col("qb"), F.xxhash64("c_ids")).mapInPandas(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
