"""Keyed state of streams, and the source of landed list pages."""

import json
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leadloom.sources import paged
from leadloom.streaming import finance_stream
from leadloom.streaming.first_seen import first_and_repeats, keyed_state


def land(spark, folder, ids):
    spark.createDataFrame([(i, 1784422800) for i in ids], "id string, created bigint").coalesce(1).write.mode("append").json(folder)


def test_state_goes_on_after_a_restart(spark, tmp_path):
    at = {x: str(tmp_path / x) for x in ("in", "out", "ck", "receipts", "repeats")}
    landed = []
    for ids in ("aab", "bc", "", "acd"):
        land(spark, at["in"], ids)
        landed += ids
        finance_stream.ingest(spark, at["in"], at["out"], at["ck"], "acct", receipts=at["receipts"], repeats=at["repeats"], now="2026-07-20 01:00:00").awaitTermination()
    got = finance_stream.counted(spark, at["out"], at["repeats"]).collect()
    assert {r.entity_id: r.repeats + 1 for r in got} == Counter(landed) and len(got) == 4
    told = spark.read.parquet(at["receipts"]).collect()
    assert sum(r.candidate_count for r in told) == len(landed) and sum(r.dedupe_count for r in told) == len(landed) - 4
    assert sum(r.sources["charges"] for r in told) == len(landed)


def test_first_is_the_least_over_all_batches(spark, tmp_path):
    folder, out = str(tmp_path / "in"), []
    with keyed_state(spark):
        for rows in ([("k", "5", "x"), ("k", "3", "y"), ("m", "1", "z")], [("k", "4", "u"), ("k", "2", "v")]):
            spark.createDataFrame(rows, "k string, o string, v string").coalesce(1).write.mode("append").json(folder)
            stream = spark.readStream.schema("k string, o string, v string").json(folder)
            told = first_and_repeats(stream, "k", "o").writeStream.outputMode("update").foreachBatch(lambda b, _: out.append({tuple(r) for r in b.collect()}))
            told.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert [o for o in out if o] == [{("k", "3", "y", "3", 2, 1, True), ("m", "1", "z", "1", 1, 0, True)}, {("k", "2", "v", "2", 2, 3, False)}]


def test_keys_are_forgotten(spark, tmp_path):
    folder, out = str(tmp_path / "in"), []
    stream = None
    with keyed_state(spark):
        land(spark, folder, "a")
        stream = first_and_repeats(spark.readStream.schema("id string, created bigint").json(folder), "id", "created", ttl_ms=1000)
        query = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            deadline = time.time() + 90
            while len(out) < 1 and time.time() < deadline:
                time.sleep(0.5)
            time.sleep(3)
            land(spark, folder, "a")
            while len(out) < 2 and time.time() < deadline:
                time.sleep(0.5)
        finally:
            query.stop()
    assert [(r.id, r.is_new, r.repeats) for r in out] == [("a", True, 0), ("a", True, 0)]


def write_pages(folder, pages):
    folder.mkdir(exist_ok=True)
    for n, page in pages.items():
        (folder / f"{n:03d}.json").write_text(json.dumps(page))


PAGES = {
    0: {"data": [{"id": "a", "x": 1}, {"id": "b", "x": "ü"}], "has_more": True},
    1: {"data": [{"id": "c"}], "has_more": True, "starting_after": "b"},
    2: {"data": [{"id": "d"}], "has_more": False, "starting_after": "c"},
}


def test_pages_as_a_batch_and_as_a_stream(spark, tmp_path):
    paged.register(spark)
    folder, got = tmp_path / "in", []
    write_pages(folder, {0: PAGES[0]})

    def stream():
        read = spark.readStream.format(paged.NAME).load(str(folder)).writeStream.foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect()))
        read.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    stream()
    assert [r[2] for r in got] == ["a", "b"]
    write_pages(folder, PAGES)
    stream()  # goes on at the cursor
    batch = spark.read.format(paged.NAME).load(folder.as_uri())
    assert sorted(got) == sorted(tuple(r) for r in batch.collect()) and [r[2] for r in got] == ["a", "b", "c", "d"]
    assert batch.rdd.getNumPartitions() == 3
    assert json.loads(batch.filter("id = 'b'").first().entry) == {"id": "b", "x": "ü"}


@pytest.mark.parametrize(
    "broken",
    [{1: PAGES[1] | {"starting_after": "a"}}, {1: PAGES[1] | {"data": [], "has_more": True}}, {0: PAGES[0] | {"has_more": False}}, {2: {"data": {}}}],
    ids=["other cursor", "no cursor", "page after the last", "no list"],
)
def test_a_lost_cursor_fails(spark, tmp_path, broken):
    paged.register(spark)
    write_pages(tmp_path / "in", PAGES | broken)
    with pytest.raises(Exception, match="starts after|cursor missing|no page follows|no list"):
        spark.read.format(paged.NAME).load(str(tmp_path / "in")).collect()


def test_a_stream_whose_page_is_missing_fails(spark, tmp_path):
    paged.register(spark)
    write_pages(tmp_path / "in", {0: PAGES[0]})
    run = lambda: spark.readStream.format(paged.NAME).load(str(tmp_path / "in")).writeStream.foreachBatch(lambda b, _: b.collect()).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    run()
    write_pages(tmp_path / "in", {2: PAGES[2]})
    with pytest.raises(Exception, match="starts after c, not b"):
        run()


def test_no_pages(spark, tmp_path):
    paged.register(spark)
    (tmp_path / "in").mkdir()
    assert spark.read.format(paged.NAME).load(str(tmp_path / "in")).select(F.count("*")).first()[0] == 0
