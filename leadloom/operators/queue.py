"""Queues: due rows, opt-outs, follow-ups, run states and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Subject and lead of each step's message.
STEPS = {0: "welcome", 1: "reminder", 2: "proof", 3: "last_call"}
#: The steps of the follow-ups of local businesses, which have no last call.
FOLLOWUP_STEPS = {0: "welcome", 1: "reminder", 2: "proof"}


def queued(runs: DataFrame, limit: int = 25) -> DataFrame:
    return runs.filter(F.col("status") == "queued").orderBy(F.col("requested_at").asc_nulls_last(), "id").limit(limit)


def due(queue: DataFrame, now: Column, limit: int = 50, status: str = "pending") -> DataFrame:
    return queue.filter((F.col("status") == status) & (F.col("scheduled_for") <= now)).orderBy(F.col("scheduled_for").asc_nulls_last(), "id").limit(limit)


def split_opted_out(rows: DataFrame, optouts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to send, to delete): rows whose address isn't, or is, among the opt-outs."""
    key = F.lower(F.btrim(F.col("email")))
    gone = optouts.select(F.lower(F.btrim("email")).alias("_gone")).distinct()
    return rows.join(gone, key == F.col("_gone"), "left_anti"), rows.join(gone, key == F.col("_gone"), "left_semi")


def with_copy(rows: DataFrame, steps: dict[int, str] | None = None) -> DataFrame:
    """Adds template: the step's, or that of step 0 for other steps."""
    steps = STEPS if steps is None else steps
    return rows.withColumn("template", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in steps.items() for x in kv]), F.col("step").cast("int")), F.lit(steps[0])))


def followups(unique: DataFrame, now: Column, minimum: int = 50, limit: int = 20, score: str = "lead_score") -> DataFrame:
    """The best unique leads with an address, a minute apart. Keyed by run and entity, so a
    second run adds nothing."""
    few = unique.filter((F.col(score) >= minimum) & (F.coalesce("email", F.lit("")) != "")).orderBy(F.desc(score), "first_seen").limit(limit)
    place = F.row_number().over(Window.orderBy(F.desc(score), "first_seen")) - 1  # over `limit` rows at most
    return few.withColumn("place", place).withColumns({"scheduled_for": now + F.make_interval(mins=F.col("place")), "step": F.lit(0), "status": F.lit("pending")})


def settle(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue after sending: delivered rows leave it, failed ones are marked. results: id, ok."""
    done = queue.join(results.select("id", "ok"), "id", "left")
    return done.filter(~F.coalesce("ok", F.lit(False))).withColumn("status", F.when(F.col("ok").isNotNull(), "failed").otherwise(F.col("status"))).drop("ok")


def resolve_run(runs: DataFrame, run_id: int | None = None) -> DataFrame:
    """The run asked for, or the one processed last; a delivered or failed run doesn't qualify."""
    fit = runs.filter(F.col("status").isin("processed", "processed_manual"))
    return fit.filter(F.col("id") == run_id) if run_id is not None else fit.orderBy(F.col("processed_at").desc_nulls_first(), F.desc("id")).limit(1)


def delivery(leads: DataFrame, limit: int | None = 50, score: str = "lead_score") -> DataFrame:
    """The best leads with a row number and label; at most 100."""
    few = leads.orderBy(F.desc(score), "id").limit(min(limit or 50, 100))
    label = F.when(F.col(score) >= 80, "high").when(F.col(score) >= 50, "usable").otherwise("low")
    return few.withColumns({"row_index": F.row_number().over(Window.orderBy(F.desc(score), "id")), "label": label})


def update_runs(runs: DataFrame, summaries: DataFrame, key: str = "id") -> DataFrame:
    """New values where a summary has some, old ones elsewhere (runs.failed_without_items marks runs that no items came for)."""
    new = [c for c in summaries.columns if c != key]
    joined = runs.join(summaries.select(key, *[F.col(c).alias(f"_{c}") for c in new]), key, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", *([c] if c in runs.columns else [])) for c in new}).drop(*[f"_{c}" for c in new])
