"""Micro-batches of landed items: normalised, scored, resolved, stored per batch.

A batch that is run again overwrites its own folder, so results don't depend on restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import api
from ..sources.landing import lead_records


def ingest(spark: SparkSession, landing: str, out: str, checkpoint: str, model: str = "full", context_niche: str = "", context_city: str = "") -> StreamingQuery:
    """Unique leads of each batch under out/batch_id=<n>; lines that aren't JSON are left out."""
    lines = spark.readStream.text(landing)

    def write(batch: DataFrame, batch_id: int) -> None:
        # The order of items in a batch is that of their texts, which no restart changes.
        items = batch.select(F.try_parse_json("value").alias("item"), F.col("value").alias("ord")).filter(F.col("item").isNotNull())
        unique = api.process(lead_records(items, context_niche, context_city), model).unique
        columns = ["business_name", "website", "phone", "email", "city", "niche", "lead_score", "score_band", "recommended_action", "score_reasons", "canonical_entity_id", "raw_item_hash"]
        unique.select(*columns).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """One row per entity over all batches: that of the newest batch."""
    from ..operators.upsert import latest_wins

    rows = spark.read.parquet(out)
    return latest_wins(rows.limit(0), rows, ["canonical_entity_id"], "batch_id")


def first_seen_only(stream: DataFrame, key: str, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """A stream without repeats of a key: for ever, or within the delay if an event time is named."""
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
