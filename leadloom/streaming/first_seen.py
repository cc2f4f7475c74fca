"""Keyed state of streams: the first record of each key, and how often the key came again.

The state store holds one value per key (RocksDB, in the query's checkpoint), so a micro-batch
looks up its own keys only, however many were seen before, and a restart goes on where the last one ended.
`counted_keys` is a streaming aggregate; `first_and_repeats` tells a batch's rows of each key, and forgets keys, at the
price of several calls between Python and the store for each key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _FirstSeen(StatefulProcessor):
    def __init__(self, key: str, order: str, columns: list[str], ttl_ms: int | None) -> None:
        self._key, self._order, self._columns, self._ttl = key, order, columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("first", "first string, n long", ttlDurationMs=self._ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        first, n = None, 0
        for row in rows:
            n += 1
            if first is None or (str(row[self._order]), str(row)) < (str(first[self._order]), str(first)):
                first = row
        before = self._state.get() if self._state.exists() else None
        earliest = min(str(first[self._order]), before[0]) if before else str(first[self._order])
        total = n + (before[1] if before else 0)
        self._state.update((earliest, total))
        yield Row(**{self._key: key[0]}, **{c: first[c] for c in self._columns}, first_order=earliest, batch_rows=n, repeats=total - 1, is_new=before is None)

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, as values by key need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def first_and_repeats(stream: DataFrame, key: str, order: str, ttl_ms: int | None = None) -> DataFrame:
    """One row for each key of a micro-batch: the batch's first record of it (the least `order`, compared as text), first_order (the least
    ever), batch_rows, repeats (how often the key came again, over all batches), is_new. Start the query in
    `keyed_state` and with output mode `update`.

    ttl_ms: a key that isn't seen for so long is forgotten, and is new when it comes again; such queries run
    until they are stopped, as time alone changes their state."""
    columns = [f for f in stream.schema.fields if f.name != key]
    kinds = [f"`{key}` {stream.schema[key].dataType.simpleString()}", *[f"`{f.name}` {f.dataType.simpleString()}" for f in columns]]
    schema = ", ".join([*kinds, "first_order string", "batch_rows long", "repeats long", "is_new boolean"])
    processor = _FirstSeen(key, order, [f.name for f in columns], ttl_ms)
    return stream.groupBy(key).transformWithState(processor, outputStructType=schema, outputMode="Update", timeMode="None" if ttl_ms is None else "ProcessingTime")


def counted_keys(stream: DataFrame, key: str, order: str, per: str | None = None) -> DataFrame:
    """One row for each key of a micro-batch: the batch's first record of it (the least `order`, a text), repeats (over all
    batches), is_new. Start the query in `keyed_state` and with output mode `update`. The state keeps a record for each key, so
    leave out what can be derived.

    per: a column; each value of it gives one more row a batch (of_key is false, the key null) with batch_rows, the number of the batch's
    records. A batch is known by its time, which a restart keeps."""
    rest = [c for c in stream.columns if c not in (key, order)]
    rows = stream.withColumns({"_batch": F.lit(None).cast("timestamp"), "_at": F.current_timestamp()})
    if per:
        own = F.struct(F.col(key).alias("k"), F.col("_batch").alias("b"))
        told = F.struct(F.lit(None).cast(stream.schema[key].dataType).alias("k"), F.col("_at").alias("b"))
        rows = rows.withColumn("_as", F.explode(F.array(own, told))).withColumns({key: F.col("_as.k"), "_batch": F.col("_as.b")})
    of_key = F.col("_batch").isNull()
    kind = F.when(~of_key, F.col(per).cast("string")) if per else F.lit(None).cast("string")
    # Of the newest batch the least.
    first = F.min(F.struct((-F.unix_micros("_at")).alias("late"), F.col(order).alias("o"), *rest)).alias("_first")
    one = rows.groupBy(key, "_batch", kind.alias("_per")).agg(first, F.count("*").alias("_n"), F.min("_at").alias("_since"), F.max("_at").alias("_last"))
    return one.select(
        key, F.col("_first.o").alias(order), *[F.col(f"_first.{c}").alias(c) for c in rest], F.when(~of_key, F.col("_n")).alias("batch_rows"),
        F.when(of_key, F.col("_n") - 1).alias("repeats"), (of_key & (F.col("_since") == F.col("_last"))).alias("is_new"), of_key.alias("of_key"),
    )
