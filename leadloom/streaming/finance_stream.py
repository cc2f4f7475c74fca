"""Micro-batch ingestion of landed payment events, idempotent on replay.

Which dedupe keys are new is kept as keyed state of the query, so a batch looks up its own keys and reads no stored
signal. New signals go to the batch's own folder; a batch that is run again finds the state as it
was before it, and overwrites its folder. Outside the window of a run nothing is read: the run
leaves a receipt that says so, and the next one takes over. Each batch leaves a receipt, too, if asked to."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import moment
from ..operators.finance import keyed, list_candidates, receipt
from .first_seen import counted_keys, keyed_state


def ingest(spark: SparkSession, landing: str, out: str, checkpoint: str, account: str, source: str = "charge", signal_type: str = "stripe_charge", receipts: str | None = None, repeats: str | None = None, now: str | None = None) -> StreamingQuery | None:
    """`now`: the time of the run, in UTC; if it is given and not between 0 and 6 o'clock, there is no query.
    repeats: a folder for how often each key of a batch has come again so far."""
    if now is not None and datetime.fromisoformat(now).hour > 5:
        if receipts:
            empty = spark.createDataFrame([], "source string")
            receipt(empty, empty, False, moment(now)).write.mode("overwrite").parquet(f"{receipts}/run={datetime.fromisoformat(now):%Y%m%dT%H%M%S}")
        return None
    entries = spark.readStream.schema("id string, created bigint").json(landing)
    signals = lambda rows: keyed(list_candidates(rows, source, signal_type, F.col("event_date")), account)
    found = keyed(list_candidates(entries, source, signal_type, F.lit(None).cast("date")), account).select("dedupe_key", "entity_id", "event_date", "source")
    states = counted_keys(found, "dedupe_key", "entity_id", "source" if receipts else None)

    def write(batch: DataFrame, batch_id: int) -> None:
        told = batch.persist()  # one row per key of the batch, and one per source
        # The rest of a signal follows from its id and date.
        signals(told.filter("is_new").select(F.col("entity_id").alias("id"), F.lit(None).cast("long").alias("created"), "event_date")).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        if repeats:
            told.filter("of_key").select("dedupe_key", "repeats").write.mode("overwrite").parquet(f"{repeats}/batch_id={batch_id}")
        if receipts:
            receipt(told.filter("not of_key"), told.filter("is_new"), True, None if now is None else moment(now), "batch_rows").write.mode("overwrite").parquet(f"{receipts}/run=batch_{batch_id}")
        told.unpersist()

    with keyed_state(spark):
        return states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(spark: SparkSession, out: str, repeats: str) -> DataFrame:
    """The stored signals with their repeats over all batches."""
    most = spark.read.parquet(repeats).groupBy("dedupe_key").agg(F.max("repeats").alias("repeats"))
    return spark.read.parquet(out).join(most, "dedupe_key")
