"""Summaries of runs that new items alone bring up to date.

Two keyed tables of a store: one row per duplicate group (counts, sum, best score, its record) and one per
run (counts, routing, the k best groups). Rows of groups can be merged, in any order and number: counts and sums
add up, the best is the least choice. A run's counts are sums over its groups, so a batch adds what its
groups give after it less what they gave before; the best of a run are among those it had and
the batch's groups, as a group's best never gets worse. So a batch reads and writes the buckets of its own groups and
runs, whatever else is stored, and the result is that of one pass over all items."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from .store import Snapshot, Store, Table


@dataclass(frozen=True)
class RunState:
    """What is counted: `by` names the run, `columns` what the k best records show, `signals` a column that is added up."""

    by: tuple[str, ...] = ("run_id",)
    score: str = "lead_score"
    order: str = "ord"
    high: int = 80
    nurture: int = 50
    k: int = 3
    columns: tuple[str, ...] = ("ord", "lead_score")
    signals: str | None = None
    buckets: int = 64

    @property
    def groups(self) -> Table:
        return Table("groups", (*self.by, "duplicate_group_id"), self.buckets)

    @property
    def runs(self) -> Table:
        return Table("runs", self.by, self.buckets)


_GROUP_SUMS = ["n", "score_sum", "high", "usable", "low", "signals"]
_RUN_SUMS = ["total", "unique_count", "score_sum", "high", "usable", "low", "signals", "instant_alert", "nurture", "hold"]


def of_items(scored: DataFrame, s: RunState) -> DataFrame:
    """One row per group, each task sending one."""
    band = lambda b: F.count_if(F.col("score_band") == b).alias(b)
    choice = F.struct((-F.col(s.score)).cast("double").alias("s"), F.col(s.order).alias("o"))
    signals = F.coalesce(F.sum(s.signals), F.lit(0)).cast("long") if s.signals else F.lit(0).cast("long")
    return scored.groupBy(*s.groups.keys).agg(
        F.count("*").alias("n"), F.sum(F.col(s.score).cast("double")).alias("score_sum"), band("high"), band("usable"), band("low"), signals.alias("signals"),
        F.min(choice).alias("best"), F.min(s.order).alias("first_seen"), F.min_by(F.struct(*s.columns), choice).alias("item"),
    )


def merged_groups(parts: list[DataFrame], s: RunState) -> DataFrame:
    """Rows of groups from several batches, as one row per group."""
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(*s.groups.keys).agg(*[F.sum(c).alias(c) for c in _GROUP_SUMS], F.min("best").alias("best"), F.min("first_seen").alias("first_seen"), F.min_by("item", "best").alias("item"))


def of_groups(groups: DataFrame, s: RunState, sign: int = 1) -> DataFrame:
    """One row per run; with sign -1 what the groups have to be taken out by."""
    best = -F.col("best.s")
    aggs = {
        "total": F.sum("n"), "unique_count": F.count("*"), **{c: F.sum(c) for c in ("score_sum", "high", "usable", "low", "signals")},
        "instant_alert": F.count_if(best >= s.high), "nurture": F.count_if((best >= s.nurture) & (best < s.high)), "hold": F.count_if(best < s.nurture),
    }
    return groups.groupBy(*s.by).agg(*[(sign * x).alias(c) for c, x in aggs.items()])


def _entries() -> Column:
    return F.struct(F.col("best.s").alias("s"), "first_seen", F.col("best.o").alias("o"), F.col("duplicate_group_id").alias("g"), "item")


def _best(entries: DataFrame, s: RunState) -> DataFrame:
    """top: the k best entries of each run; of a group's entries the newest, which is the least."""
    # The rank filter comes first, so only k rows of a run meet.
    one = entries.groupBy(*s.by, F.col("entry.g").alias("g")).agg(F.min_by("entry", F.struct("entry.s", "entry.first_seen", "entry.o")).alias("entry"))
    place = F.row_number().over(Window.partitionBy(*s.by).orderBy("entry.s", "entry.first_seen", "entry.g"))
    few = one.withColumn("place", place).filter(F.col("place") <= s.k)
    return few.groupBy(*s.by).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"]).alias("top"))


def add(store: Store, scored: DataFrame, s: RunState = RunState(), batch: tuple[str, int] | None = None) -> None:
    """Adds items (by, duplicate_group_id, score, score_band, order, columns) to the groups and runs of the store, in one commit."""
    keys = list(s.groups.keys)

    def change(own: Snapshot) -> None:
        parts = of_items(scored, s)
        before: list[DataFrame] = []

        def merge(there: DataFrame | None, new: DataFrame) -> DataFrame:
            if there is None:
                return new
            before.append(there.join(new.select(*keys), keys, "left_semi"))
            return merged_groups([there, new], s)

        touched = parts.select(*keys)
        after = own.merge(s.groups, parts, merge).join(touched, keys, "left_semi")
        sums = [of_groups(after, s), *[of_groups(b, s, -1) for b in before]]
        delta = reduce(DataFrame.unionByName, sums).groupBy(*s.by).agg(*[F.sum(c).alias(c) for c in _RUN_SUMS])
        fresh = delta.join(_best(after.select(*s.by, _entries().alias("entry")), s), list(s.by), "left")

        def add_up(there: DataFrame | None, new: DataFrame) -> DataFrame:
            if there is None:
                return new
            both = there.unionByName(new)
            totals = both.groupBy(*s.by).agg(*[F.sum(c).alias(c) for c in _RUN_SUMS])
            return totals.join(_best(both.select(*s.by, F.explode("top").alias("entry")), s), list(s.by), "left")

        own.merge(s.runs, fresh, add_up)

    store.update(change, batch)


def summaries(store: Store, s: RunState = RunState()) -> DataFrame | None:
    """by, counts, duplicate_rate, average_score, routing, top_items; None before the first batch."""
    runs = store.read(s.runs.name)
    if runs is None:
        return None
    items = F.transform("top", lambda x: x["item"]).alias("top_items")
    rate = ratio(F.col("total") - F.col("unique_count"), F.col("total"), 3).alias("duplicate_rate")
    return runs.select(*s.by, "total", "unique_count", "high", "usable", "low", rate, ratio(F.col("score_sum"), F.col("total"), 1).alias("average_score"), "instant_alert", "nurture", "hold", F.col("signals").alias("total_signals"), items)
