"""Run states as an ordered fold over a transition table; transitions that it doesn't allow are refused.

An event is a function from state to state: to its target if the table allows it, else to the state itself. Functions of consecutive
events compose to one of as many entries as there are states, in any grouping, so no run's events have to meet: events are
dealt by run and time into ranges, each range's into blocks of `block`; blocks are folded to functions, these to those of a
run's part in a range, and these to the run's. On the way back each part and block gets the state that it begins in,
and its events are told accepted or refused."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import shared_folder

#: The states of a run ("" before its record is there), and what each may become.
TRANSITIONS = {
    "": ["queued", "capped", "processed_manual"], "queued": ["processing", "processed", "failed"], "processing": ["processed", "failed"],
    "processed": ["sample_delivered"], "processed_manual": ["sample_delivered"], "failed": ["queued"], "capped": ["queued"], "sample_delivered": [],
}


def _entries(function: Column, states: int) -> Column:
    """The function's value for each state."""
    return F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: F.aggregate(function, s, lambda at, f: F.element_at(f, at + 1)))


def _starts(functions: Column, start: Column) -> Column:
    """The state before each of consecutive functions, and the last one's result."""
    return F.aggregate(functions, F.array(start), lambda seen, f: F.concat(seen, F.array(F.element_at(f, F.element_at(seen, F.lit(-1)) + 1))))


def _in_order(keys: list[str], rows: DataFrame, by: str) -> DataFrame:
    """One row per keys: their functions, and what these are called, in the order of `by`."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(by).alias("i"), F.col("f").alias("f"))))
    return rows.groupBy(*keys).agg(listed.alias("l")).select(*keys, F.transform("l", lambda x: x["i"]).alias("names"), F.transform("l", lambda x: x["f"]).alias("fs"))


def fold(events: DataFrame, transitions: dict[str, list[str]] | None = None, block: int = 1000) -> DataFrame:
    """events: run_id, ts, id, status; each run's in the order of ts and id. Adds accepted (whether the table lets the run go from the state
    it is in to the status; not for an unknown status) and state (the run's after the event). A run begins in ""."""
    table = TRANSITIONS if transitions is None else transitions
    names = list(table)
    n = len(names)
    allowed = F.array(*[F.lit(b in table[a]) for a in names for b in names])
    target = F.array_position(F.array(*map(F.lit, names)), F.col("status")).cast("int") - 1  # -1 for others
    spark = events.sparkSession
    parted = events.withColumn("_to", F.coalesce(target, F.lit(-1))).repartitionByRange("run_id", "ts", "id").sortWithinPartitions("run_id", "ts", "id")
    # Written, so that places in it are fixed.
    path = shared_folder(spark, f"runs-{uuid.uuid4().hex[:8]}")
    parted.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumns({"_part": F.shiftright("_at", 33), "_block": F.floor(F.col("_at").bitwiseAND((1 << 33) - 1) / block)})
    one = lambda to: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.when((to >= 0) & F.element_at(allowed, s * n + F.greatest(to, F.lit(0)) + 1), to).otherwise(s))
    rows = rows.withColumn("f", one(F.col("_to")))
    blocks = _in_order(["run_id", "_part", "_block"], rows, "_at")
    parts = _in_order(["run_id", "_part"], blocks.select("run_id", "_part", "_block", _entries(F.col("fs"), n).alias("f")), "_block")
    runs = _in_order(["run_id"], parts.select("run_id", "_part", _entries(F.col("fs"), n).alias("f")), "_part")

    def back(level: DataFrame, start: Column, name: str) -> DataFrame:
        keys = [c for c in level.columns if c in ("run_id", "_part", "_block")]
        states = level.withColumn("s", _starts(F.col("fs"), start))
        each = F.arrays_zip(F.col("names").alias(name), F.slice("s", F.lit(1), F.size("names")).alias("start"), F.slice("s", F.lit(2), F.size("names")).alias("end"))
        return states.select(*keys, F.explode(each).alias("x")).select(*keys, F.col(f"x.{name}").alias(name), "x.start", "x.end")

    of_parts = back(runs, F.lit(0), "_part").drop("end")
    of_blocks = back(parts.join(of_parts, ["run_id", "_part"]), F.col("start"), "_block").drop("end")
    of_events = back(blocks.join(of_blocks, ["run_id", "_part", "_block"]), F.col("start"), "_at").select("run_id", "_at", "start", "end")
    told = rows.join(of_events.withColumnRenamed("run_id", "_run"), "_at")
    state = F.element_at(F.array(*map(F.lit, names)), F.col("end") + 1)
    accepted = (F.col("_to") >= 0) & F.element_at(allowed, F.col("start") * n + F.greatest("_to", F.lit(0)) + 1)
    return told.select(*events.columns, accepted.alias("accepted"), state.alias("state"))


def last_states(folded: DataFrame) -> DataFrame:
    """One row per run: its state, how many events were accepted and refused."""
    last = F.max_by("state", F.struct("ts", "id")).alias("state")
    return folded.groupBy("run_id").agg(last, F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))
