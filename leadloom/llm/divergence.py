"""Source divergence audit: which sources of a language differ, and by which terms.

Within each language every source p is held against every other source q by the sum over the language's
kept terms of f = floor((p - q)^2 / q), on smoothed shares in billionths.

Few of the terms occur in any one source, so sums are baseline-corrected over an inverted index: a
pair starts at V times the f of two zero counts, and postings (term, source, count) emit only what
differs from it. A posting against a source without the term depends on its share alone, so such postings
are counted by share first and emit one correction per share and other source; where two
sources have a term, a self-join of the index on the term emits the rest, each two sources
once for both directions. Nothing is emitted for the sources that lack a term, however many they are.
All corrections of a pair are summed before the shuffle.

Terms are ranked within (lang, source) by a window whose rank filter runs before the
shuffle, too, so a task sends `terms` rows a group at most. Counts are summed within tasks, whole
texts at a time, before they are shuffled by term; a hot source sends one row per task and term.

Arithmetic is exact: shares by decimals, f and its sums by 64-bit integers (shares are at most 10^9 + 1 and
add up to 10^9 + V in a source, so a sum over terms stays below (10^9 + V)^2).

Defined results: null text, lang, source count as empty; a document is a row, so repeated rows count
each; groups without terms and languages without kept terms have pairs (of value 0 in the latter)
but no terms; a language with one source has no pairs; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, discard, shuffles_dropped, small_batches, written


@dataclass(frozen=True)
class Audit:
    #: Documents of a language that a kept term occurs in, at least.
    min_docs: int = 3
    scale: int = 1_000_000_000
    smoothing: int = 1
    #: Terms reported for each group.
    terms: int = 200
    #: Entries that a task gathers before it sends them on.
    gathered: int = 400_000


#: A-Z become a-z; bytes that belong to no term become spaces (all of a character beyond ASCII are from 0x80 on).
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def counted(docs: DataFrame, p: Audit) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term; each time a task sends its counts
    it counts `min_docs` of them at most, as no more are asked for); a row for each time that a task sends the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        size = 0

        def sent() -> pa.RecordBatch:
            rows = [(lang, source, t.decode("utf-8", "replace"), n, seen[t]) for (lang, source), (often, seen, _) in groups.items() for t, n in often.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.string()] * 3 + [pa.int64()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                often, seen, enough = groups.setdefault((lang, source), (Counter(), Counter(), set()))
                before = len(often)
                terms = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
                often.update(terms)
                fresh = set(terms) - enough
                seen.update(fresh)
                enough.update(t for t in fresh if seen[t] >= p.min_docs)
                size += len(often) - before
                if size > p.gathered:
                    yield sent()
                    groups, size = {}, 0
        if groups:
            yield sent()

    named = small_batches(docs).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return named.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(n: str, total: str, kept: str, p: Audit) -> Column:
    """1 + floor(scale * (n + smoothing) / (total + smoothing * kept)), null for no kept terms; by decimals where 64 bits don't do."""
    above, below = f"(({n}) + {p.smoothing})", f"nullif(({total}) + {p.smoothing} * ({kept}), 0)"
    wide = f"cast({above} as decimal(20,0)) * {p.scale}BD div cast({below} as decimal(20,0))"
    return F.expr(f"1 + CASE WHEN {above} <= {2**63 // p.scale - 1}L THEN {above} * {p.scale}L div {below} ELSE {wide} END")


def _f(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def index(docs: DataFrame, p: Audit = Audit()) -> tuple[DataFrame, DataFrame]:
    """(postings, groups). postings: lang, source, term, n, p, q for the terms that each group has (q: the
    language's share). groups: lang, source, kept (V of the language), p0 (share of a zero count)."""
    # One shuffle, by language and term, serves the sums of parts, the counts of documents and the choice of terms.
    parts = counted(docs, p).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    known = parts.withColumns({"all_n": F.sum("n").over(of_term), "all_docs": F.sum("docs").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
    held = written(known.filter(F.col("all_docs") >= p.min_docs).select("lang", "term", "source", "n", "all_n", "first"))
    # A language's kept terms and occurrences; a group's occurrences.
    langs = held.filter("first").groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    there = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = there.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("total"), zero("kept"), zero("lang_total"))
    groups = checkpoint(groups.withColumn("p0", _share("0L", "total", "kept", p)))
    shares = {"p": _share("n", "total", "kept", p), "q": _share("all_n", "lang_total", "kept", p)}
    postings = written(held.join(groups, ["lang", "source"]).withColumns(shares).select("lang", "source", "term", "n", "p", "q", "p0"))
    discard(held)
    return postings, groups.select("lang", "source", "kept", "p0")


def pair_sums(postings: DataFrame, groups: DataFrame, salts: int = 16) -> DataFrame:
    """lang, source, item (each other source), value."""
    # Pairs of one language are dealt over `salts` tasks.
    left = groups.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(salts)))
    right = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")).withColumn("salt", F.explode(F.array(*[F.lit(s).cast("long") for s in range(salts)])))
    pairs = checkpoint(left.join(right, ["lang", "salt"]).filter("source <> item").select("lang", "source", "item", "kept", "p0", "q0"))
    start = pairs.select("lang", "source", "item", F.coalesce(F.expr(f"kept * ({_f('p0', 'q0')})"), F.lit(0)).alias("value"))

    # One has the term, the other has not: in both directions, by share.
    by_share = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    ways = F.explode(F.array(
        F.struct(F.col("source").alias("source"), F.col("item").alias("item"), F.expr(f"terms * ({_f('p', 'q0')} - {_f('p0', 'q0')})").alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"terms * ({_f('q0', 'p')} - {_f('q0', 'p0')})").alias("value")),
    )).alias("x")
    alone = by_share.join(pairs, ["lang", "source"]).select("lang", ways).select("lang", "x.*")

    # Both have it: what the two corrections above got wrong.
    a = postings.select("lang", "term", "source", "p", "p0")
    b = postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("p0").alias("r0"))
    over = lambda x, x0, y, y0: F.expr(f"{_f(x, y)} - {_f(x, y0)} - {_f(x0, y)} + {_f(x0, y0)}")
    both = a.join(b, ["lang", "term"]).filter("source < item").select("lang", "source", "item", over("p", "p0", "r", "r0").alias("there"), over("r", "r0", "p", "p0").alias("back"))
    both = both.groupBy("lang", "source", "item").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    ways = F.explode(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))).alias("x")
    both = both.select("lang", ways).select("lang", "x.*")
    return start.unionByName(alone).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, p: Audit = Audit()) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    with shuffles_dropped(docs.sparkSession):
        postings, groups = index(docs, p)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = pair_sums(postings, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", place)
    told = postings.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    terms = told.select("lang", "source", F.lit("term").alias("part"), "item", "value", place).filter(F.col("rank") <= p.terms)
    return pairs.unionByName(terms)
