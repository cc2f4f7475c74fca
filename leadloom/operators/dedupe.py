"""Entity resolution: the best record of a group, and first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _choice(score: str, order: str) -> Column:
    """The least of these is the group's best: the highest score, of equals the earliest."""
    return F.struct((-F.col(score)).alias("s"), F.col(order).alias("o"))


def flag_best(df: DataFrame, group: list[str], score: str, order: str = "ord", hot: int = 1000) -> DataFrame:
    """Adds is_unique (the group's highest score, of equals the earliest; `order` tells a group's records apart) and first_seen
    (the order of the group's first record).

    Two phases, so that no group is gathered: each task sends one row per group, its best score and first order; these are
    joined back to the records. A group with more than one in `hot` of the records would be one
    task's in that join; there are fewer than `hot` of them, so they are broadcast, and their records are
    spread over the tasks of the others."""
    best_ = df.groupBy(*group).agg(F.min(_choice(score, order)).alias("_best"), F.min(order).alias("first_seen"), F.count("*").alias("_n"))
    total = best_.agg(F.sum("_n").alias("_all"))  # one row
    sized = best_.crossJoin(F.broadcast(total))
    key = F.concat_ws("\x00", *[F.coalesce(F.col(g).cast("string"), F.lit("\x01")) for g in group])
    side = lambda rows, p: rows.select(key.alias(f"_{p}_key"), F.col("_best").alias(f"_{p}_best"), F.col("first_seen").alias(f"_{p}_seen"))
    is_hot = F.col("_n") * hot > F.col("_all")
    out = df.withColumn("_key", key).join(F.broadcast(side(sized.filter(is_hot), "hot")), F.col("_key") == F.col("_hot_key"), "left")
    spread = F.when(F.col("_hot_key").isNull(), F.col("_key")).otherwise(F.concat(F.lit("\x02"), F.col(order).cast("string")))
    out = out.withColumn("_own", spread).join(side(sized.filter(~is_hot), "cold"), F.col("_own") == F.col("_cold_key"), "left")
    chosen = F.coalesce("_hot_best", "_cold_best")
    return out.select(*df.columns, (chosen == _choice(score, order)).alias("is_unique"), F.coalesce("_hot_seen", "_cold_seen").alias("first_seen"))


def best(df: DataFrame, group: list[str], score: str, order: str = "ord") -> DataFrame:
    """The best record of each group, with first_seen: one aggregate, of which each task sends a row per group."""
    rest = [c for c in df.columns if c not in group]
    one = df.groupBy(*group).agg(F.min_by(F.struct(*rest), _choice(score, order)).alias("_best"), F.min(order).alias("first_seen"))
    return one.select(*[F.col(c) if c in group else F.col(f"_best.{c}").alias(c) for c in df.columns], "first_seen")


def ranked(unique: DataFrame, score: str, limit: int | None = None) -> DataFrame:
    """By score, ties by the group's first appearance; a limit is a top-k, not a full sort."""
    out = unique.orderBy(F.desc(score), "first_seen")
    return out if limit is None else out.limit(limit)


def first_new(candidates: DataFrame, key: str, seen: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """First occurrences of keys that `seen` doesn't have yet."""
    fresh = candidates if seen is None else candidates.join(seen.select(key), key, "left_anti")
    rest = [c for c in fresh.columns if c != key]
    one = fresh.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return one.select(*[F.col(key) if c == key else F.col(f"_first.{c}").alias(c) for c in fresh.columns])
