"""Language identification with a blended-spectrum string kernel.

A text is the set of its byte n-grams of several orders (lower-cased, UTF-8; only
presence counts). The kernel of two texts is the mean over orders of
|A n B| / sqrt(|A| |B|). A Nystroem map over landmark texts and ridge regression,
one language against the rest, are fitted on a bounded sample: at most `sample`
rows of each language, `landmarks` of them landmarks, those whose ids have the
smallest hashes, so the sample doesn't depend on the order of rows. Executors reduce its texts: the driver
gets the n-gram sets of the landmarks (at most 256^3 codes, whatever a text's length) and
one row of kernel values for each text of the sample.

Every whole text is then scored in batches: presence matrix times landmark matrix,
times weights. The model is a few MB whatever the input's size; scoring has no
shuffle.

Defined results: `und` with score 0 for a null text, a text without letters, or
where nothing could be learned; ties go to the smaller language name; rows
with a null doc_id are never learned from and count as not held out; equal rows (doc_id, lang and text) are learned
from once; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small_batches, written


@dataclass(frozen=True)
class Kernel:
    orders: tuple[int, ...] = (1, 2, 3)
    sample: int = 300
    landmarks: int = 16
    ridge: float = 1e-2
    #: Sharpness of the scores (softmax of the regressions' outputs).
    sharpness: float = 6.0
    batch: int = 256


def grams(text: str, order: int) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < order:
        return np.empty(0, np.uint32)
    code = raw[: len(raw) - order + 1].copy()
    for j in range(1, order):
        code <<= np.uint32(8)
        code |= raw[j : len(raw) - order + 1 + j]
    return np.unique(code)


class Model:
    """Landmarks, given as their n-gram sets by order; after `solve` also the fitted regressions."""

    def __init__(self, marks: list[list[np.ndarray]], langs: list[str], k: Kernel):
        self.k, self.langs = k, sorted(set(langs))
        self.vocab, self.there = [], []
        for n in range(len(k.orders) if marks else 0):
            sets = [m[n] for m in marks]
            vocab = np.unique(np.concatenate(sets))
            there = np.zeros((len(vocab), len(marks)), np.float32)
            for j, s in enumerate(sets):
                there[np.searchsorted(vocab, s), j] = 1 / np.sqrt(max(1, len(s)))
            self.vocab.append(vocab)
            self.there.append(there)

    def solve(self, near: np.ndarray, langs: list[str], marks: list[int]) -> Model:
        """near: kernel values of the sample with the landmarks, a row a text; marks: the landmarks' rows."""
        value, vector = np.linalg.eigh((near[marks] + near[marks].T) / 2)
        keep = value > 1e-8 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        phi = np.hstack([near @ root, np.ones((len(near), 1))])
        target = np.where(np.array(langs)[:, None] == np.array(self.langs), 1.0, -1.0)
        solved = np.linalg.solve(phi.T @ phi + self.k.ridge * np.eye(phi.shape[1]), phi.T @ target)
        self.weights, self.bias = (root @ solved[:-1]).astype("f4"), solved[-1].astype("f4")
        return self

    def row(self, text: str) -> np.ndarray:
        """Kernel values of one text with the landmarks, summed in double precision, so that they don't
        depend on what else is in a batch."""
        out = 0
        for order, vocab, there in zip(self.k.orders, self.vocab, self.there, strict=True):
            g = grams(text, order)
            out = out + there[np.isin(vocab, g, assume_unique=True)].sum(0, dtype="f8") / np.sqrt(max(1, len(g)))
        return out / len(self.k.orders)

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values of the texts with the landmarks: one matrix product per order."""
        out = 0
        for order, vocab, there in zip(self.k.orders, self.vocab, self.there, strict=True):
            has = np.zeros((len(texts), len(vocab)), np.float32)
            for i, text in enumerate(texts):
                g = grams(text, order)
                if len(g) and len(vocab):
                    at = np.minimum(np.searchsorted(vocab, g), len(vocab) - 1)
                    has[i, at[vocab[at] == g]] = 1 / np.sqrt(len(g))
            out = out + has @ there
        return out / len(self.k.orders)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        z = self.kernel(texts) @ self.weights + self.bias
        best = z.argmax(1)
        e = np.exp(self.k.sharpness * (z - z.max(1, keepdims=True)))
        return best, 1 / e.sum(1)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, k: Kernel = Kernel()) -> Model:
    """Learns from the text and lang of documents that aren't held out."""
    usable = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out()
    keyed = docs.filter(usable).select("doc_id", "lang", "text", F.xxhash64("text").alias("key"))
    key = ["doc_id", "lang", "key"]
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "key"))
    # At most `sample` keys of each language: a rank filter before the shuffle keeps no more of each task.
    chosen = keyed.select(*key).withColumn("place", place).filter(F.col("place") <= k.sample).groupBy(*key).agg(F.min("place").alias("place"))
    rows = small_batches(written(keyed.join(F.broadcast(chosen), key).dropDuplicates(key).select("lang", "place", "text")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [[grams(t, order).tobytes() for order in k.orders] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("place"), pa.array(codes, pa.list_(pa.binary()))], ["lang", "place", "grams"])

    by_place = lambda r: (r["lang"], r["place"])
    marks = sorted(rows.filter(F.col("place") <= k.landmarks).mapInArrow(sets, "lang string, place int, grams array<binary>").collect(), key=by_place)
    model = Model([[np.frombuffer(g, np.uint32) for g in r["grams"]] for r in marks], [r["lang"] for r in marks], k)
    if marks:

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = [model.row(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("place"), pa.array(near, pa.list_(pa.float64()))], ["lang", "place", "near"])

        sample = sorted(rows.mapInArrow(values, "lang string, place int, near array<double>").collect(), key=by_place)
        at = {by_place(r): i for i, r in enumerate(sample)}
        model.solve(np.array([r["near"] for r in sample]), [r["lang"] for r in sample], [at[by_place(r)] for r in marks])
    discard(rows)
    return model


def has_letter(text: str | None) -> bool:
    return next(filter(str.isalpha, text or ""), None) is not None


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score, one row per row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, model.k.batch):
                part = whole.slice(at, model.k.batch)
                texts = part.column(2).to_pylist()
                use = [i for i, t in enumerate(texts) if model.langs and has_letter(t)]
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                if use:
                    for i, b, s in zip(use, *model.predict([texts[i] for i in use]), strict=True):
                        lang[i], score[i] = model.langs[b], float(s)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
