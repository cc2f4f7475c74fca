"""Mixing sources to target weights: iterative proportional fitting.

Documents fall into cells (source, language, topic). The cells' token weights
are raked in turns to the target shares of each marginal; a document's sampling
probability is its cell's calibrated weight over its tokens, scaled so that none is above
one (or, with `whole` above 0, so that cells with up to this share of all tokens
are taken whole); the choice is a hash of doc_id, so it repeats.

Native. Texts are read once, for tokens and topic. Cells are pre-aggregated (so a
hot source is one row for each of its cells); a turn sums the cells of a marginal's
value (partially before the shuffle, so no task gets all cells of a topic) and joins the
scale back. Rounds end when all marginals are within `tolerance` of their targets, or after `rounds`. Targets that can't all be
met (a value whose only documents are of a language that is wanted less, say) are never met by more rounds: how far the worst
marginal is off is a column of the result, `miss`, and a warning if it is above the tolerance. The fitted cells
are joined back to documents.

Defined results: null source, language or topic is a cell value of its own; a
null or empty text has 0 tokens and weighs nothing in the fit, and follows its
cell's probability (0 if the cell has no tokens); equal doc_ids share one fate;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, discard, uniform, words_of, written

#: Topic rules, first match wins: a name and a pattern that the text has to contain.
TOPICS = {
    "legal": r"(?i)licen[sc]e|copyright|all rights reserved",
    "tabular": r" \| ",
    "contact": r"@[a-z0-9]+\.|\+[0-9]{1,3} \(",
}
DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Mix:
    """Targets: shares for each value of a dimension, or None for shares in
    proportion to tokens to the power `temper`. Values that have a target but no
    tokens are left out, and those with tokens but no target get none."""

    targets: dict[str, dict[str, float] | None] = field(default_factory=dict)
    temper: float = 0.5
    #: Rounds at most; fewer if every marginal is within `tolerance` of its target, as a share of all tokens.
    rounds: int = 24
    tolerance: float = 1e-4
    #: Cells most wanted for their size are taken whole, up to this share of all tokens; their weights
    #: are then cut, so targets are missed. At 0 or below no probability is cut at one and weights are
    #: met exactly, at the price of a smaller sample: at 0 the most wanted cells get probability one,
    #: below 0 the next step of a geometric scale does (as in the SQL twin).
    whole: float = -1.0
    seed: str = "mix"
    topics: dict[str, str] = field(default_factory=lambda: TOPICS)


def topic_of(text: Column, topics: dict[str, str]) -> Column:
    out = None
    for name, pattern in topics.items():
        out = (F if out is None else out).when(text.rlike(pattern), F.lit(name))
    return F.lit("prose") if out is None else out.otherwise(F.lit("prose"))


def _sizes(docs: DataFrame, mix: Mix) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", "lang", topic_of(text, mix.topics).alias("topic"), F.size(words_of(F.col("text"))).cast("long").alias("tokens"))


def calibrated(sizes: DataFrame, mix: Mix) -> DataFrame:
    """One row per cell: its tokens, its calibrated share, the probability, and the miss of the whole fit."""
    cells = checkpoint(sizes.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("cell_tokens")))
    cells = cells.withColumn("share", F.col("cell_tokens").cast("double"))
    for d in DIMENSIONS:
        targets = mix.targets.get(d)
        if targets is None:
            marginal = cells.groupBy(d).agg(F.sum("cell_tokens").alias("m")).filter("m > 0").withColumn("m", F.pow(F.col("m").cast("double"), F.lit(mix.temper)))
        else:
            pairs = F.explode(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]))
            present = cells.filter("cell_tokens > 0").select(d).distinct()
            marginal = cells.sparkSession.range(1).select(pairs.alias(d, "m")).join(present, d, "left_semi")
        total = marginal.agg(F.sum("m")).first()[0] or 1.0
        marginal = marginal.select(F.col(d).alias(f"k_{d}"), (F.col("m") / F.lit(float(total))).alias(f"target_{d}"))
        cells = cells.join(marginal, F.col(d).eqNullSafe(F.col(f"k_{d}")), "left").drop(f"k_{d}").withColumn(f"target_{d}", F.coalesce(f"target_{d}", F.lit(0.0)))
    # Written rather than checkpointed: a checkpoint keeps the planner's estimate of its size, which every join
    # squares. Cells are few, so they go into few files.
    files = cells.count() // 200_000 + 1
    cells = written(cells.coalesce(files))
    miss = 0.0
    for _ in range(mix.rounds):
        before = cells
        for d in DIMENSIONS:
            there = cells.groupBy(F.col(d).alias("_k")).agg(F.sum("share").alias("_there"))
            scaled = F.when(F.col("_there") > 0, F.col("share") * F.col(f"target_{d}") / F.col("_there")).otherwise(F.lit(0.0))
            cells = cells.join(there, F.col(d).eqNullSafe(F.col("_k"))).withColumn("share", scaled).drop("_k", "_there")
        cells = written(cells.coalesce(files))
        discard(before)
        miss = _miss(cells)
        if miss <= mix.tolerance:
            break
    else:
        warnings.warn(f"after {mix.rounds} rounds a marginal is off by {miss:.6f} of all tokens, more than {mix.tolerance}: the targets can't all be met, or not so soon", stacklevel=2)
    cells = cells.withColumn("ratio", F.when(F.col("cell_tokens") > 0, F.col("share") / F.col("cell_tokens")).otherwise(F.lit(0.0)))
    most = _scale(cells, mix.whole)
    return cells.select(*DIMENSIONS, "cell_tokens", "share", F.least(F.lit(1.0), F.col("ratio") / F.lit(most)).alias("probability"), F.lit(float(miss)).alias("miss"))


def _miss(cells: DataFrame) -> float:
    """The largest difference of a marginal from its target."""
    each = [cells.groupBy(d).agg(F.abs(F.sum("share") - F.first(f"target_{d}")).alias("miss")).select("miss") for d in DIMENSIONS]
    return reduce(DataFrame.unionByName, each).agg(F.max("miss")).first()[0] or 0.0


def _scale(cells: DataFrame, whole: float) -> float:
    """The ratio that gets probability one: the largest, or the least step of a geometric
    scale above which cells hold at most `whole` of all tokens (the step above all cells, if
    `whole` is negative). Steps are few, whatever the number of cells, so their running
    sum is small."""
    some = cells.filter("ratio > 0")
    if whole == 0:
        return float(some.agg(F.max("ratio")).first()[0] or 1.0)
    steps = some.groupBy(F.floor(F.log2("ratio") * 4).alias("step")).agg(F.sum("cell_tokens").alias("t"))
    above = F.sum("t").over(Window.orderBy(F.desc("step"))) / F.sum("t").over(Window.partitionBy())
    step = steps.withColumn("above", above).filter(F.col("above") <= whole).agg(F.min("step")).first()[0]
    if step is None:  # the first step holds more
        step = steps.agg(F.max("step")).first()[0]
        return 1.0 if step is None else 2.0 ** ((step + 1) / 4)
    return 2.0 ** (step / 4)


def sample(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight (the cell's calibrated share),
    probability, miss (the same in all rows: how far the worst marginal is off) and sampled, for each row of `docs`."""
    sizes = checkpoint(_sizes(docs, mix))
    cells = calibrated(sizes, mix).select(*[F.col(d).alias(f"c_{d}") for d in DIMENSIONS], F.round("share", 9).alias("weight"), F.round("probability", 9).alias("probability"), F.round("miss", 9).alias("miss"))
    same = [F.col(d).eqNullSafe(F.col(f"c_{d}")) for d in DIMENSIONS]
    out = sizes.join(cells, same, "left").drop(*[f"c_{d}" for d in DIMENSIONS])
    return out.withColumn("sampled", F.coalesce(uniform(F.col("doc_id"), mix.seed) < F.col("probability"), F.lit(False)))


def keep(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The sampled documents, with their columns."""
    chosen = sample(docs, mix).filter("sampled").select(F.col("doc_id").alias("_in")).distinct()
    return docs.alias("d").join(chosen.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c._in")), "left_semi")
