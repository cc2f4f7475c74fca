"""Payment signals: candidates, new ones, receipts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import epoch_date
from ..functions.hashing import event_key, signal_key
from .dedupe import first_new
from .store import Snapshot, Store, Table


def balance_candidates(balances: DataFrame, run_date: Column) -> DataFrame:
    """balances: available and pending, arrays of structs with a currency."""
    one = lambda b: balances.select(F.explode(b).alias("x")).select(F.concat(F.lit(f"balance.{b}."), F.col("x.currency")).alias("entity_id"))
    both = one("available").unionByName(one("pending"))
    return both.select("entity_id", F.col("entity_id").alias("event_type"), F.lit("stripe_balance").alias("signal_type"), run_date.alias("event_date"), F.lit("balance").alias("source"))


def list_candidates(entries: DataFrame, source: str, signal_type: str, run_date: Column) -> DataFrame:
    """entries: id and created (seconds); entries without an id are left out."""
    return entries.filter(F.coalesce("id", F.lit("")) != "").select(
        F.col("id").alias("entity_id"), F.concat(F.lit(f"{source}."), F.col("id")).alias("event_type"), F.lit(signal_type).alias("signal_type"), F.coalesce(epoch_date(F.col("created")), run_date).alias("event_date"), F.lit(source).alias("source")
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def keyed(candidates: DataFrame, account: str) -> DataFrame:
    return candidates.withColumns({"dedupe_key": event_key(F.lit(account), "event_type", F.col("event_date")), "signal_key": signal_key("entity_id", "signal_type")})


def new_signals(candidates: DataFrame, seen: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """First occurrences of dedupe keys that aren't claimed yet."""
    return first_new(candidates, "dedupe_key", seen, order)


def stored(signals: DataFrame, new: DataFrame) -> DataFrame:
    """Signals by dedupe_key; for a signal_key that recurs the first stays and updated_at moves on."""
    both = signals.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in signals.columns if c not in ("signal_key", "updated_at")]
    first = F.min(F.struct("_o", "event_date", "dedupe_key", *[c for c in columns if c not in ("event_date", "dedupe_key")])).alias("f")
    return both.groupBy("signal_key").agg(first, F.max("updated_at").alias("updated_at")).select("signal_key", "updated_at", *[F.col(f"f.{c}").alias(c) for c in columns])


#: Names of the sources in receipts. The balance is one object, however many currencies it has.
RECEIPT_SOURCES = {"balance": "balance", "charge": "charges", "subscription": "subscriptions", "balance_transaction": "balance_transactions"}


def _empty_receipt(spark: SparkSession, mode: str, now: Column | None) -> DataFrame:
    none = F.lit(0).cast("long")
    return spark.range(1).select(_stamp(now), F.lit(False).alias("window_open"), none.alias("candidate_count"), none.alias("dedupe_count"), F.lit(False).alias("pagination_exhausted"), F.lit(mode).alias("mode"), F.create_map().cast("map<string,long>").alias("sources"))


def _stamp(now: Column | None) -> Column:
    return F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("run_timestamp_utc")


def error_receipt(spark: SparkSession, now: Column | None = None) -> DataFrame:
    """The receipt of a run that failed: nothing is counted, the window doesn't count as open, the mode is `error`."""
    return _empty_receipt(spark, "error", now)


def receipt(candidates: DataFrame, new: DataFrame, window_open: bool = True, now: Column | None = None, entries: str | None = None) -> DataFrame:
    """run_timestamp_utc, window_open, candidate_count, dedupe_count, pagination_exhausted, mode, and
    sources: a map of how many entries each source gave. entries: a column that tells how many candidates a row stands for."""
    stamp = _stamp(now)
    if not window_open:
        return _empty_receipt(candidates.sparkSession, "outside_window_noop", now)
    n = F.lit(1) if entries is None else F.col(entries)
    of = lambda s: F.sum(F.when(F.col("source") == s, n)) if s != "balance" else F.max((F.col("source") == s).cast("long"))
    sources = F.create_map(*[x for s, name in RECEIPT_SOURCES.items() for x in (F.lit(name), F.coalesce(of(s), F.lit(0)).cast("long"))])
    total, fresh = candidates.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("candidate_count"), sources.alias("sources")), new.agg(F.count("*").alias("_new"))
    # Two aggregates of one row each.
    return total.crossJoin(fresh).select(stamp, F.lit(True).alias("window_open"), "candidate_count", (F.col("candidate_count") - F.col("_new")).alias("dedupe_count"), F.lit(True).alias("pagination_exhausted"), F.lit("read_only_ingestion").alias("mode"), "sources")


#: Tables of one commit: claimed keys, canonical signals, receipts.
CLAIMS, SIGNALS, RECEIPTS = Table("finance_event_dedupe", ("dedupe_key",)), Table("finance_signals", ("signal_key",)), Table("quiet_receipt_log", ("run_timestamp_utc",), 8)


def claimed(there: DataFrame | None, rows: DataFrame, by: str, order: str = "ord") -> DataFrame:
    """Claims with those of `rows` that nobody has made yet, the first of each key; claimed_by tells whose they are."""
    new = first_new(rows, "dedupe_key", there, order).withColumn("claimed_by", F.lit(by))
    return new if there is None else there.unionByName(new, allowMissingColumns=True)


def persist(store: Store, candidates: DataFrame, account: str, now: Column, window_open: bool = True, batch: tuple[str, int] | None = None, order: str = "ord") -> tuple[int, int] | None:
    """Claims keys, stores the signals of new ones and a receipt, all in one commit: (inserted_count, dedupe_count), or None
    if the batch was committed before. If anything fails, what stays is a receipt that says so, and the error is raised.

    Of two runs that claim a key at once one has it; the other merges again and finds it taken."""
    spark = candidates.sparkSession
    rows = keyed(candidates, account)
    latest = lambda there, new: new if there is None else there.join(new, "run_timestamp_utc", "left_anti").unionByName(new)

    def change(own: Snapshot) -> tuple[int, int]:
        if not window_open:
            own.merge(RECEIPTS, receipt(rows, rows, False, now), latest)
            return 0, 0
        new = own.merge(CLAIMS, rows, lambda there, found: claimed(there, found, own.commit, order)).filter(F.col("claimed_by") == own.commit)
        signals = new.drop("claimed_by", order).withColumn("updated_at", now)
        own.merge(SIGNALS, signals, lambda there, found: stored(found.limit(0) if there is None else there, found))
        told = own.merge(RECEIPTS, receipt(rows, new, True, now), latest).orderBy(F.desc("run_timestamp_utc"))
        last = told.join(spark.range(1).select(_stamp(now)), "run_timestamp_utc").first()
        return last.candidate_count - last.dedupe_count, last.dedupe_count

    try:
        return store.update(change, batch)
    except Exception:
        store.update(lambda own: own.merge(RECEIPTS, error_receipt(spark, now), latest))
        raise
