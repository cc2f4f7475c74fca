"""Counts of a batch, in one aggregate over flagged records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio


def counts(flagged: DataFrame, score: str = "lead_score", by: tuple[str, ...] = (), signals: str | None = None) -> DataFrame:
    """total, unique_count, high, usable, low, duplicate_rate, average_score of records
    with is_unique and score_band; bands count all records, not only unique ones."""
    band = lambda b: F.count_if(F.col("score_band") == b)
    aggs = [F.count("*").alias("total"), F.count_if("is_unique").alias("unique_count"), band("high").alias("high"), band("usable").alias("usable"), band("low").alias("low"), F.coalesce(F.sum(score), F.lit(0)).alias("_sum")]
    if signals:
        aggs.append(F.coalesce(F.sum(signals), F.lit(0)).alias("total_signals"))
    out = flagged.groupBy(*by).agg(*aggs)
    return out.withColumns({"duplicate_rate": ratio(F.col("total") - F.col("unique_count"), F.col("total"), 3), "average_score": ratio(F.col("_sum"), F.col("total"), 1)}).drop("_sum")


def groups(scored: DataFrame, score: str = "lead_score", by: tuple[str, ...] = (), signals: str | None = None) -> DataFrame:
    """One row per duplicate group, partially aggregated before the shuffle, so a hot group is a row a task:
    what counts and routing need of it. Its best record has its highest score."""
    band = lambda b: F.count_if(F.col("score_band") == b)
    aggs = [F.count("*").alias("_n"), F.sum(score).alias("_sum"), F.max(score).alias("_best"), band("high").alias("_high"), band("usable").alias("_usable"), band("low").alias("_low")]
    return scored.groupBy(*by, "duplicate_group_id").agg(*aggs, *([F.sum(signals).alias("_signals")] if signals else []))


def counts_of_groups(grouped: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """As counts(), from groups()."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    aggs = [total("_n").alias("total"), F.count("*").alias("unique_count"), *[total(f"_{b}").alias(b) for b in ("high", "usable", "low")], total("_sum").alias("_all")]
    if "_signals" in grouped.columns:
        aggs.append(total("_signals").alias("total_signals"))
    out = grouped.groupBy(*by).agg(*aggs)
    return out.withColumns({"duplicate_rate": ratio(F.col("total") - F.col("unique_count"), F.col("total"), 3), "average_score": ratio(F.col("_all"), F.col("total"), 1)}).drop("_all")


def routing_of_groups(grouped: DataFrame, high: int = 80, nurture: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """As routing(), from groups()."""
    s = F.col("_best")
    return grouped.groupBy(*by).agg(F.count_if(s >= high).alias("instant_alert"), F.count_if((s >= nurture) & (s < high)).alias("nurture"), F.count_if(s < nurture).alias("hold"))


def batch_summary(flagged: DataFrame, score: str = "lead_score", by: tuple[str, ...] = ()) -> DataFrame:
    """total, unique_count, and score and action of the best unique record (null if there is none)."""
    best = F.max(F.when(F.col("is_unique"), F.struct(score, "recommended_action")))
    return flagged.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("is_unique").alias("unique_count"), best.alias("_b")).select(*by, "total", "unique_count", F.col(f"_b.{score}").alias("top_score"), F.col("_b.recommended_action").alias("top_action"))


def across_runs(counts: DataFrame) -> DataFrame:
    """Totals over the counts of several runs: runs, total_fetched and what they hold."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return counts.agg(F.count("*").alias("runs"), total("total").alias("total_fetched"), total("unique_count").alias("unique_count"), total("high").alias("high"))


def routing(flagged: DataFrame, score: str = "lead_score", high: int = 80, nurture: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """instant_alert, nurture and hold over unique records."""
    u, s = F.col("is_unique"), F.col(score)
    return flagged.groupBy(*by).agg(F.count_if(u & (s >= high)).alias("instant_alert"), F.count_if(u & (s >= nurture) & (s < high)).alias("nurture"), F.count_if(u & (s < nurture)).alias("hold"))


def top(flagged: DataFrame, by: list[str], k: int, score: str, columns: list[str]) -> DataFrame:
    """top_items: the k best unique records of each group, as an ordered array. Only k
    rows of a group ever meet (a rank filter comes first)."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "first_seen"))
    few = flagged.filter("is_unique").withColumn("_rank", rank).filter(F.col("_rank") <= k)
    items = F.transform(F.sort_array(F.collect_list(F.struct("_rank", *columns))), lambda x: F.struct(*[x[c].alias(c) for c in columns]))
    return few.groupBy(*by).agg(items.alias("top_items"))


def outcomes(results: DataFrame, by: tuple[str, ...] = ("source",)) -> DataFrame:
    return results.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("ok")).alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
