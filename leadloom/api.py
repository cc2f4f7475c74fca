"""What users call: one entry point per process."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.hashing import hash32, intake_key, stable_group_id
from .functions.text import first_filled, is_email, normalize_domain, normalize_email, normalize_form, normalize_phone, normalize_text
from .operators import budget, dedupe, finance, queue, summary, upsert
from .plans.models import MODELS


@dataclass(frozen=True)
class Batch:
    """Lazy results over one scored table; persist `items` if several are used."""

    items: DataFrame
    unique: DataFrame
    top_items: DataFrame
    counts: DataFrame
    routing: DataFrame


def with_groups(records: DataFrame, model: str) -> DataFrame:
    """duplicate_group_id and canonical_entity_id as each model defines them."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    if model == "simple":
        parts = ["business_name", "website", "phone", "email", "city"]
        # Grouped by the fields themselves, as a 32-bit hash would merge businesses; group_hash is that hash.
        group = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
        canonical = hash32(F.concat_ws("|", F.coalesce("business_name", F.lit("")), first_filled("website", "phone", "email"), F.coalesce("city", F.lit(""))))
        return records.withColumns({"duplicate_group_id": group, "group_hash": hash32(group), "canonical_entity_id": canonical})
    if model == "jobs":
        group = stable_group_id(low("company_name"), low("job_title"), "source")
    elif model == "posts":
        group = stable_group_id(first_filled("post_id", "posting_url"), "company_name", "subreddit")
    else:
        last = [F.col("fingerprint")] if model == "full" and "fingerprint" in records.columns else []
        group = stable_group_id("business_name", first_filled("website", "phone", "email", *last), first_filled("city", "context_city"))
    return records.withColumns({"duplicate_group_id": group, "canonical_entity_id": group})


def normalized_leads(raw: DataFrame, model: str = "hvac") -> DataFrame:
    """raw_name, raw_website, raw_phone and raw_email become the record's own fields. The
    simple model keeps websites and phone numbers as texts."""
    simple = model == "simple"
    return raw.withColumns(
        {
            "business_name": normalize_text("raw_name"),
            "website": normalize_text("raw_website") if simple else normalize_domain("raw_website"),
            "phone": normalize_text("raw_phone") if simple else normalize_phone("raw_phone"),
            "email": normalize_email("raw_email"),
        }
    )


def score(records: DataFrame, model: str) -> DataFrame:
    return MODELS[model].apply(records)


def process(records: DataFrame, model: str = "hvac", by: tuple[str, ...] = (), order: str = "ord") -> Batch:
    """Scores, resolves duplicates, counts and routes records; `by` (such as a run's id) keeps
    batches apart, so that all runs are one plan instead of a loop."""
    m = MODELS[model]
    scored = with_groups(score(records, model), model)
    flagged = dedupe.flag_best(scored, [*by, "duplicate_group_id"], m.score, order)
    # The best records need no join back: one aggregate gives them.
    unique = dedupe.best(scored, [*by, "duplicate_group_id"], m.score, order).withColumn("is_unique", F.lit(True))
    signals = "signal_count" if model == "posts" else None
    # Counts and routing need one row per group.
    grouped = summary.groups(scored, m.score, by, signals)
    return Batch(flagged, unique, dedupe.ranked(unique, m.score, 10), summary.counts_of_groups(grouped, by), summary.routing_of_groups(grouped, m.high, m.nurture, by))


def due_messages(waiting: DataFrame, optouts: DataFrame, now: Column, limit: int = 50, steps: dict[int, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages to send with their template, rows to delete)."""
    send, drop = queue.split_opted_out(queue.due(waiting, now, limit), optouts)
    return queue.with_copy(send, steps), drop


def delivery(runs: DataFrame, leads: DataFrame, run_id: int | None = None, limit: int | None = 50) -> DataFrame:
    run = queue.resolve_run(runs, run_id).select(F.col("id").alias("run_id"))
    return queue.delivery(leads.join(F.broadcast(run), "run_id"), limit)  # one run


def ingest_finance(candidates: DataFrame, seen: DataFrame | None, window_open: bool, account: str, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new signals, receipt)."""
    rows = finance.keyed(candidates, account)
    new = finance.new_signals(rows, seen)
    return (new if window_open else new.limit(0)), finance.receipt(rows, new, window_open, now)


def intake(requests: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Valid requests, one row each, with a receipt; repeats raise duplicate_count."""
    fields = ["name", "email", "niche", "city", "cadence", "notes"]
    clean = requests.withColumns({f: normalize_form(f) for f in fields})
    clean = clean.withColumns({"email": F.lower("email"), "cadence": first_filled("cadence", F.lit("weekly"))})
    valid = clean.filter(is_email("email") & (F.col("name") != "") & (F.col("niche") != "") & (F.col("city") != ""))
    return upsert.insert_or_bump(valid.withColumn("dedupe_key", intake_key(*fields)), "dedupe_key", existing=existing)


def upsert_optouts(existing: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    return upsert.latest_wins(existing, new.withColumn("email", F.lower(F.btrim("email"))), ["email"], order)


def budget_check(scenarios: DataFrame, simulate: bool = False) -> DataFrame:
    return budget.simulate(scenarios) if simulate else budget.check(scenarios)


def sync_subscribers(existing: DataFrame, events: DataFrame, customers: DataFrame) -> DataFrame:
    return upsert.merge_by(existing, upsert.subscriber_states(events, customers), "email")
