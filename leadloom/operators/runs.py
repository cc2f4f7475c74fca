"""Run records, their storage rows, spend logs and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .upsert import latest_wins


def run_records(checked: DataFrame, requested_at: Column) -> DataFrame:
    """Rows to append for launched or refused runs: queued if the budget allows, else capped."""
    return checked.select("*", F.when(F.col("allowed"), "queued").otherwise("capped").alias("status"), requested_at.alias("requested_at"))


def failed_without_items(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Queued runs that no items came for are marked failed, so they can't clog the queue."""
    some = items.select(F.col("run_id").alias("_r"), F.lit(True).alias("_some")).distinct()
    joined = runs.join(some, F.col("id") == F.col("_r"), "left")
    return joined.withColumn("status", F.when((F.col("status") == "queued") & F.col("_some").isNull(), "failed").otherwise(F.col("status"))).drop("_r", "_some")


def raw_rows(items: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Raw items keyed by payload hash; a later run takes over the row. items: run_id, payload."""
    rows = items.withColumn("payload_hash", F.sha1(F.col("payload").cast("binary"))).select("payload_hash", "run_id", "payload")
    return latest_wins(rows.limit(0) if existing is None else existing, rows, ["payload_hash"], "run_id")


def lead_rows(unique: DataFrame, existing: DataFrame | None = None, order: str = "lead_score") -> DataFrame:
    """Leads keyed by run and entity, the batch's winners only."""
    return latest_wins(unique.limit(0) if existing is None else existing, unique, ["run_id", "canonical_entity_id"], order)


def spend_log(runs: DataFrame) -> DataFrame:
    """Estimated and actual cost per run, and the difference. runs: id, est_cost, actual_cost."""
    return runs.select("id", "est_cost", "actual_cost", (F.coalesce("actual_cost", "est_cost") - F.col("est_cost")).alias("difference"))


def cascade(children: DataFrame, parents: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Children whose parents are still there; children without a parent stay."""
    kept = children.filter(F.col(foreign).isNotNull()).join(parents.select(F.col(key).alias(foreign)).distinct(), foreign, "left_semi")
    return kept.unionByName(children.filter(F.col(foreign).isNull()))


def delivery_stats(delivered: DataFrame) -> DataFrame:
    return delivered.agg(F.count_if(F.col("label") == "high").alias("high"), F.count_if(F.col("label") == "usable").alias("usable"), F.count_if(F.col("label") == "low").alias("low"), F.count("*").alias("delivered"))


def usage_limits(spark: SparkSession, path: str) -> DataFrame:
    """monthly_usage and plan_limit from a landed usage document (one row)."""
    item = F.try_parse_json(F.col("value"))
    read = spark.read.text(path, wholetext=True)
    usage = F.try_variant_get(item, "$.data.current.monthlyUsageUsd", "double")
    limit = F.try_variant_get(item, "$.data.limits.maxMonthlyUsageUsd", "double")
    return read.select(F.coalesce(usage, F.lit(0.0)).alias("monthly_usage"), F.coalesce(limit, F.lit(0.0)).alias("plan_limit"))
