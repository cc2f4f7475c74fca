"""Quality rules: base counts, then divergence from language references.

Two histograms of a document (character classes; common words of some
languages and all others) are compared with those of whole languages
by the Jensen-Shannon distance (base 2, 0 to 1). The references are learned for every language
of the table, as sums over all its documents that pass the base rules. A document beyond a limit may be
written in two languages, so it is compared with the blends, in equal parts, of its language's
reference and each other one, too; the smallest distance counts. Guards: a histogram of a
text with few characters or words is not judged, nor is one whose language has too few such
documents, in number or as a share of all.

Native: one pass of SQL functions over the texts; its small results are
checkpointed, so that texts aren't read again once the references are known. As each reference
holds a share of the documents, there are at most 1 / min_reference_share of them; they
are one literal of the plan.

Defined results: a null text counts as empty; an empty text has zero counts and
fails the base rules; a document without a language is compared with the
nearest reference, one whose language has no reference with none; repeated rows are judged one by one;
columns of the input other than the ones used are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, let, words_of

#: Frequent function words, by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "las", "del"],
}
#: Character classes, each with its pattern among the characters that are neither a-z nor white space.
CLASSES = {"upper": r"[A-Z]", "digit": r"[0-9]", "point": r"[.,;:?'\"()\-]", "symbol": r"[#*$%&|<>]", "loud": r"[!]", "other": r"[^\x00-\x7F]"}
N_CLASSES = len(CLASSES) + 3  # with a-z, white space and what remains


@dataclass(frozen=True)
class Divergence:
    """Limits of the method; the defaults are those used in production."""

    max_char_distance: float = 0.33
    max_word_distance: float = 0.275
    min_chars: int = 200
    min_words: int = 100
    min_reference_docs: int = 20
    min_reference_share: float = 0.001
    common_words: dict[str, list[str]] = field(default_factory=lambda: COMMON_WORDS)

    @property
    def vocabulary(self) -> list[str]:
        return list(dict.fromkeys(w for ws in self.common_words.values() for w in ws))


def _repeated(words: Column, width: int) -> Column:
    """Words within windows of `width` words that occur twice or more."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(starts, j + 1) - x, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def starts(pairs: Column) -> Column:
        at = F.transform(pairs, lambda p, k: F.when((F.coalesce(F.get(pairs, k - 1)["h"] == p["h"], F.lit(False))) | (F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False))), p["i"]))
        return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

    def judge(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, lambda p: let(starts(p), covered)))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(windows, judge))


def features(docs: DataFrame, rule: Divergence = Divergence()) -> DataFrame:
    """One row per document: counts and histograms, in one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    vocabulary = rule.vocabulary

    def of_words(words: Column) -> Column:
        common = F.filter(words, lambda w: w.isin(vocabulary))
        count = lambda c, v: F.size(F.filter(c, lambda w: w == v))
        counts = let(common, lambda c: F.array(*[count(c, v) for v in vocabulary]))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeated(words, 8).cast("long").alias("n_repeat_words"),
            counts.alias("word_counts"),
        )

    def of_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    def of_rest(rest: Column) -> Column:
        return F.struct(F.length(rest).alias("n"), F.array(*[F.regexp_count(rest, F.lit(p)) for p in CLASSES.values()]).alias("counts"))

    found = docs.select(
        F.col("doc_id"),
        F.col("lang"),
        F.length(text).cast("long").alias("n_chars"),
        let(words_of(F.col("text")), of_words).alias("w"),
        let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]")), of_lines).alias("n_dup_lines"),
        let(F.regexp_replace(text, r"[a-z \x09-\x0D]+", ""), of_rest).alias("r"),
    )
    return found.select(
        "doc_id", "lang", "n_chars", "w.n_words", "w.word_chars", "w.n_repeat_words", "n_dup_lines", "w.word_counts", F.col("r.n").alias("n_rest"), F.col("r.counts").alias("rest_counts"),
    )


def _histograms(found: DataFrame) -> DataFrame:
    """Adds n_symbols and the two histograms, as arrays of counts."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    symbol = list(CLASSES).index("symbol")
    space = F.col("n_chars") - F.col("word_chars")
    return found.select(
        "*",
        F.get("rest_counts", F.lit(symbol)).cast("long").alias("n_symbols"),
        F.concat(F.array((F.col("n_chars") - F.col("n_rest") - space).cast("double"), space.cast("double")), F.transform("rest_counts", lambda x: x.cast("double")), F.array((F.col("n_rest") - total(F.col("rest_counts"))).cast("double"))).alias("char_hist"),
        F.concat(F.transform("word_counts", lambda x: x.cast("double")), F.array((F.col("n_words") - total(F.col("word_counts"))).cast("double"))).alias("word_hist"),
    )


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def references(found: DataFrame, rule: Divergence) -> dict[str, tuple[list[float], list[float]]]:
    """Shares of each class and word, by language, over all documents that pass the base rules. Only
    languages with a share of min_reference_share come to the driver, so their number is bounded."""
    n = len(rule.vocabulary) + 1
    sums = [F.sum(F.get("char_hist", F.lit(i))).alias(f"c{i}") for i in range(N_CLASSES)] + [F.sum(F.get("word_hist", F.lit(i))).alias(f"w{i}") for i in range(n)]
    good = found.filter(F.col("lang").isNotNull() & ~_base_failed())
    least = max(rule.min_reference_docs, math.ceil(rule.min_reference_share * good.count()))
    rows = good.groupBy("lang").agg(F.count("*").alias("docs"), *sums).filter(F.col("docs") >= least).collect()
    out = {}
    for r in rows:
        chars, words = [r[f"c{i}"] for i in range(N_CLASSES)], [r[f"w{i}"] for i in range(n)]
        out[r["lang"]] = [x / sum(chars) for x in chars], [x / sum(words) for x in words]
    return out


def distance(hist: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of an array of counts and an array of shares."""

    def of(shares: Column) -> Column:
        def part(p: Column, q: Column) -> Column:
            m = (p + q) / 2
            half = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
            return (half(p) + half(q)) / 2

        terms = F.zip_with(shares, reference, part)
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))

    total = F.aggregate(hist, F.lit(0.0), lambda a, x: a + x)
    return let(let(total, lambda t: F.transform(hist, lambda x: x / F.greatest(t, F.lit(1.0)))), of)


def judge(docs: DataFrame, rule: Divergence = Divergence()) -> DataFrame:
    """doc_id, the base counts, the distances, base_failed and kept, one row per
    row of `docs` (doc_id, text, lang). Distances are null where a guard holds."""
    found = _histograms(checkpoint(features(docs, rule)))
    known = references(found, rule)

    def nearest(hist: str, which: int, limit: float) -> Column:
        if not known:
            return F.lit(None).cast("double")
        table = F.from_json(F.lit(json.dumps({k: v[which] for k, v in known.items()})), "map<string, array<double>>")
        to_each = lambda of: F.array_min(F.transform(F.map_values(table), lambda r: distance(F.col(hist), of(r))))
        blends = lambda own: to_each(lambda r: F.zip_with(own, r, lambda a, b: (a + b) / 2))
        # Blends are looked at only beyond the limit.
        told = lambda own: let(distance(F.col(hist), own), lambda d: F.when(d <= limit, d).otherwise(F.least(d, blends(own))))
        return F.when(F.col("lang").isNull(), to_each(lambda r: r)).otherwise(let(F.element_at(table, F.col("lang")), lambda r: F.when(r.isNotNull(), told(r))))

    base = _base_failed()
    out = found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"),
        F.when(F.col("n_chars") >= rule.min_chars, F.round(nearest("char_hist", 0, rule.max_char_distance), 6)).alias("char_distance"),
        F.when(F.col("n_words") >= rule.min_words, F.round(nearest("word_hist", 1, rule.max_word_distance), 6)).alias("word_distance"),
    )
    near = (F.coalesce(F.col("char_distance"), F.lit(0.0)) <= rule.max_char_distance) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= rule.max_word_distance)
    return out.withColumn("kept", ~F.col("base_failed") & near)


def keep(docs: DataFrame, rule: Divergence = Divergence()) -> DataFrame:
    """The documents that the rules keep, with their columns. Rows that share a
    doc_id are kept only if none of them is rejected."""
    bad = judge(docs, rule).filter(~F.col("kept")).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.alias("d").join(bad.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b._bad")), "left_anti")
