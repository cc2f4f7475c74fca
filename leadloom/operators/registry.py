"""The registry of discovered entities. Keys and merge rules are our design, from the shape
of the table alone: key precedence canonical key, url, then entity, place and signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _text
from .identity import connected


def with_key(rows: DataFrame) -> DataFrame:
    """Adds registry_key to canonical_key, url, entity, geo, signal."""
    filled = lambda c: F.nullif(F.btrim(_text(c)), F.lit(""))
    parts = F.concat_ws("|", *[F.lower(filled(c)) for c in ("entity", "geo", "signal")])
    return rows.withColumn("registry_key", F.coalesce(F.concat(F.lit("key:"), filled("canonical_key")), F.concat(F.lit("url:"), F.lower(filled("url"))), F.concat(F.lit("esg:"), F.left(F.sha1(parts.cast("binary")), F.lit(16)))))


def merged(rows: DataFrame) -> DataFrame:
    """One row per key: first_seen_at, last_seen_at, merged_count, source_lanes, best score."""
    return with_key(rows).groupBy("registry_key").agg(
        F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), (F.count("*") - 1).alias("merged_count"), F.sort_array(F.collect_set("lane")).alias("source_lanes"), F.max("score").alias("score")
    )


def _keys() -> Column:
    """The keys of a row: canonical, url, and entity with place and signal (where there is an entity)."""
    filled = lambda c: F.nullif(F.btrim(_text(c)), F.lit(""))
    parts = F.concat_ws("|", *[F.lower(F.coalesce(filled(c), F.lit(""))) for c in ("entity", "geo", "signal")])
    esg = F.when(filled("entity").isNotNull(), F.concat(F.lit("esg:"), F.left(F.sha1(parts.cast("binary")), F.lit(16))))
    return F.array_compact(F.array(F.concat(F.lit("key:"), filled("canonical_key")), F.concat(F.lit("url:"), F.lower(filled("url"))), esg))


def resolved(rows: DataFrame, filed: DataFrame | None = None, minimum: int = 50) -> DataFrame:
    """One row per entity: rows that share any key, directly or through others, are one. registry_key (the least of its keys),
    first_seen_at, last_seen_at, merged_count (rows of it), score, file_worthy, filing_state, source_lanes, and provenance: per
    lane its rows, first and last time. rows: canonical_key, url, entity, geo, signal, seen_at, lane, score; rows without any key
    are left out (see split_required). filed: registry_key of entities that were filed before, under any of their keys.

    Rows are aggregated by their first key and lane before they are joined with the labels, so an entity that has a third
    of all rows is one row per task and lane there."""
    keyed = rows.withColumn("keys", _keys()).filter(F.size("keys") > 0)
    labels = connected(keyed.select("keys"))
    by_lane = keyed.groupBy(F.col("keys")[0].alias("key"), "lane").agg(F.count("*").alias("n"), F.min("seen_at").alias("first"), F.max("seen_at").alias("last"), F.max("score").alias("score"))
    lanes = by_lane.join(labels, "key").groupBy(F.col("label").alias("registry_key"), "lane").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("score").alias("score"))
    provenance = F.sort_array(F.collect_list(F.struct("lane", F.col("n").alias("rows"), F.col("first").alias("first_seen_at"), F.col("last").alias("last_seen_at"))))
    one = lanes.groupBy("registry_key").agg(F.min("first").alias("first_seen_at"), F.max("last").alias("last_seen_at"), F.sum("n").alias("merged_count"), F.max("score").alias("score"), provenance.alias("provenance"))
    done = F.lit(False)
    if filed is not None:
        names = filed.select(F.col("registry_key").alias("key")).join(labels, "key").select(F.col("label").alias("registry_key"), F.lit(True).alias("_filed")).distinct()
        one, done = one.join(names, "registry_key", "left"), F.coalesce("_filed", F.lit(False))
    worthy = F.coalesce(F.col("score") >= minimum, F.lit(False))
    state = F.when(done, "filed").otherwise("ready")
    return one.select("registry_key", "first_seen_at", "last_seen_at", "merged_count", "score", worthy.alias("file_worthy"), state.alias("filing_state"), F.array_sort(F.transform("provenance", lambda x: x["lane"])).alias("source_lanes"), "provenance")


def file_worthy(registry: DataFrame, minimum: int = 50) -> DataFrame:
    return registry.filter(F.col("score") >= minimum)
