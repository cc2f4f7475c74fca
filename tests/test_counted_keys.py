"""Keys of payment events are counted by a streaming aggregate, without calls of Python for each key (F3)."""

from pyspark.sql import functions as F

from leadloom.streaming import finance_stream
from leadloom.streaming.first_seen import counted_keys, keyed_state


def test_keys_of_the_stream_are_an_aggregate(spark, tmp_path):
    at = {x: str(tmp_path / x) for x in ("in", "out", "ck", "receipts", "repeats")}
    for ids in ("aab", "bc"):
        spark.createDataFrame([(i, 1784422800) for i in ids], "id string, created bigint").write.mode("append").json(at["in"])
        query = finance_stream.ingest(spark, at["in"], at["out"], at["ck"], "acct", receipts=at["receipts"], repeats=at["repeats"], now="2026-07-20 01:00:00")
        query.awaitTermination()
        assert {s["operatorName"] for p in query.recentProgress for s in p["stateOperators"]} == {"stateStoreSave"}
    got = {(r.entity_id, r.event_type, r.signal_type, str(r.event_date), r.source, r.repeats) for r in finance_stream.counted(spark, at["out"], at["repeats"]).collect()}
    assert got == {(i, f"charge.{i}", "stripe_charge", "2026-07-19", "charge", n) for i, n in (("a", 1), ("b", 1), ("c", 0))}
    told = spark.read.parquet(at["receipts"]).orderBy("run").select("candidate_count", "dedupe_count", F.col("sources")["charges"]).collect()
    assert [tuple(r) for r in told] == [(3, 1, 3), (2, 1, 2)]


def test_a_batch_tells_its_first_record_and_rows(spark, tmp_path):
    folder, out = str(tmp_path / "in"), []
    with keyed_state(spark):
        for rows in ([("k", "3", "y", "s"), ("k", "5", "x", "s"), ("m", "1", "z", "t")], [("k", "4", "u", "s"), ("k", "7", "v", "s")]):
            spark.createDataFrame(rows, "k string, o string, v string, p string").write.mode("append").json(folder)
            stream = spark.readStream.schema("k string, o string, v string, p string").json(folder)
            told = counted_keys(stream, "k", "o", "p").writeStream.outputMode("update").foreachBatch(lambda b, _: out.append({(r.k, r.o, r.v, r.repeats, r.is_new) if r.of_key else (r.p, r.batch_rows) for r in b.collect()}))
            told.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert [o for o in out if o] == [{("k", "3", "y", 1, True), ("m", "1", "z", 0, True), ("s", 2), ("t", 1)}, {("k", "4", "u", 3, False), ("s", 2)}]
