"""Idempotent writes, as table in, table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .store import Store, Table


def _orderable(df: DataFrame, columns: list[str]) -> Column:
    """A hash over the columns that breaks ties; of VARIANT and MAP columns, which have no order, over their JSON."""
    plain = lambda c: F.to_json(F.col(c)) if isinstance(df.schema[c].dataType, (MapType, VariantType)) else F.col(c)
    return F.xxhash64(*[plain(c) for c in columns]) if columns else F.lit(0)


def latest_wins(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: of the new rows, and then the existing ones, that with the highest `order`, of
    equals that with the highest hash. Rows with a null in the key never meet, as nulls are
    distinct in a unique index. Rows are aggregated before the shuffle."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    rest = [c for c in both.columns if c not in (*keys, "_new")]
    last = F.max_by(F.struct("_new", *rest), F.struct("_new", F.col(order).alias("_order"), _orderable(both, rest).alias("_tie"))).alias("_last")
    kept = both.filter(whole).groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in (*rest, "_new")])
    return kept.unionByName(both.filter(~whole)).drop("_new")


def insert_or_bump(requests: DataFrame, key: str, order: str = "ord", sla: str = "INTERVAL 1 DAY", at: str = "received_at", existing: DataFrame | None = None) -> DataFrame:
    """One row per key: the first request's columns, sla_due_at, and how often it came again.
    existing: rows of earlier calls, whose receipts stay and whose counts go on."""
    rest = [c for c in requests.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(F.col(order).alias("_order"), _orderable(requests, rest).alias("_tie"))).alias("_first")
    one = requests.groupBy(key).agg(first, F.count("*").alias("_n")).select(key, *[F.col(f"_first.{c}").alias(c) for c in rest], "_n")
    fresh = one.withColumns({"duplicate_count": F.col("_n") - 1, "sla_due_at": F.col(at) + F.expr(sla), "status": F.lit("queued")})
    if existing is None:
        return fresh.drop("_n")
    bumped = existing.join(fresh.select(key, F.col("_n").alias("_more")), key, "left").withColumn("duplicate_count", F.col("duplicate_count") + F.coalesce("_more", F.lit(0))).drop("_more")
    return bumped.unionByName(fresh.join(existing.select(key), key, "left_anti").drop("_n"), allowMissingColumns=True)


def upsert_into(store: Store, table: Table, rows: DataFrame, order: str, batch: tuple[str, int] | None = None) -> None:
    """latest_wins, as a commit that reads and writes only the buckets of the keys of `rows`."""
    keys = list(table.keys)
    store.merge(table, rows, lambda there, new: latest_wins(new.limit(0) if there is None else there, new, keys, order), batch)


def bump_into(store: Store, table: Table, requests: DataFrame, order: str = "ord", sla: str = "INTERVAL 1 DAY", at: str = "received_at", batch: tuple[str, int] | None = None) -> None:
    """insert_or_bump, as a commit that reads and writes only the buckets of the requests' keys."""
    store.merge(table, requests, lambda there, new: insert_or_bump(new, table.keys[0], order, sla, at, there), batch)


def without(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Deletes by id."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def patch(table: DataFrame, ids: DataFrame, values: dict, key: str = "id") -> DataFrame:
    """Sets columns of the rows with these ids."""
    hit = table.join(ids.select(key, F.lit(True).alias("_hit")).distinct(), key, "left")
    return hit.withColumns({c: F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}).drop("_hit")


def merge_by(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer merge: new values that aren't null win; unknown keys are inserted."""
    columns = [c for c in dict.fromkeys([*existing.columns, *new.columns]) if c != key]
    side = lambda df, p: df.select(key, *[F.col(c).alias(f"{p}{c}") for c in df.columns if c != key])
    both = side(existing, "_o_").join(side(new.filter(F.col(key).isNotNull()), "_n_"), key, "full_outer")
    pick = lambda c: F.coalesce(*[F.col(p + c) for p, df in (("_n_", new), ("_o_", existing)) if c in df.columns]).alias(c)
    return both.select(key, *[pick(c) for c in columns])


#: States of the payment provider, and ours; others pass unchanged.
STATUSES = {"active": "active", "past_due": "past_due", "cancelled": "cancelled", "canceled": "cancelled", "unpaid": "past_due", "trialing": "trialing", "paused": "cancelled"}


def mapped_status(status: str = "status"):
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv]), F.col(status)), F.col(status))


def subscriber_states(events: DataFrame, customers: DataFrame) -> DataFrame:
    """The last state per address. events: event_id, ts, type, customer_id, email, status, tier,
    mode; customers: customer_id, customer_email. Order is by time, then event id."""
    known = events.join(customers, "customer_id", "left").withColumn("email", F.lower(F.coalesce(F.nullif("email", F.lit("")), F.col("customer_email"))))
    checkout = (F.col("type") == "checkout.session.completed") & (F.col("mode") == "subscription") & F.col("tier").isNotNull()
    state = F.when(checkout, "active").when(F.col("type") == "customer.subscription.updated", mapped_status()).when(F.col("type") == "customer.subscription.deleted", "cancelled")
    told = known.withColumn("state", state).filter(F.col("state").isNotNull() & F.col("email").isNotNull())
    last = F.row_number().over(Window.partitionBy("email").orderBy(F.desc("ts"), F.desc("event_id")))
    return told.withColumn("_rn", last).filter("_rn = 1").select("email", "customer_id", F.col("state").alias("status"), "ts")


def tag_by_email(leads: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Leads with the subscription of their address, where there is one; of several that with the highest time (`ts`, where
    subscribers have one), of equals the highest status."""
    newest = F.struct(*([F.col("ts")] if "ts" in subscribers.columns else []), F.col("status"))
    own = subscribers.groupBy(F.col("email").alias("_e")).agg(F.max(newest)["status"].alias("_s"))
    return leads.join(own, F.lower("email") == F.col("_e"), "left").withColumn("subscription_status", F.coalesce(F.col("_s"), F.lit("none"))).drop("_e", "_s")
