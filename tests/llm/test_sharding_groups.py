"""Groups stay whole: cut edges counted by brute force."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from leadloom.llm import sharding


def split_groups(spark, texts, plan=sharding.Plan()):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = sharding.assign(df, plan).select("doc_id", "shard", "slot").collect()
    held = Counter(r.shard for r in got)
    assert len(got) == len(texts) and max(held.values()) - min(held.values()) <= 1
    slots = defaultdict(set)
    for r in got:
        slots[r.shard].add(r.slot)
    assert all(s == set(range(len(s))) for s in slots.values())
    shards = defaultdict(list)
    for r in got:
        shards[texts[r.doc_id]].append(r.shard)
    split = [t for t, s in shards.items() if len(set(s)) > 1]
    cut = sum(1 for s in shards.values() for a, b in zip(sorted(s), sorted(s)[1:], strict=False) if a != b)
    return split, cut, shards


def test_cuts_split_one_group_each_at_most(spark):
    rng = random.Random(1)
    texts = []
    while len(texts) < 40_000:
        texts += [f"t{len(texts)}"] * rng.choice([2, 2, 2, 3, 4, 5, 8, 30])
    rng.shuffle(texts)
    split, cut, _ = split_groups(spark, texts)
    assert len(split) <= 7 and cut <= 7


def test_a_hot_group_and_small_ones(spark):
    """A group of a third of all rows is larger than a shard: it takes the shards it needs, others stay whole."""
    rng = random.Random(2)
    texts = ["hot"] * 4000 + [f"s{i}" for i in range(3000)]
    while len(texts) < 12_000:
        texts += [f"t{len(texts)}"] * rng.choice([2, 3, 6])
    rng.shuffle(texts)
    split, _, shards = split_groups(spark, texts)
    assert len([t for t in split if t != "hot"]) <= 7
    assert len(set(shards["hot"])) <= 8


def test_those_with_most_to_gain_move_first(spark):
    rows = spark.createDataFrame([(i, 0, 1, g) for i, g in enumerate([1, 5, 2, 100, 3, 70, 1, 64] * 20)], "node long, shard int, to int, gain long")
    got = sharding._ranked(rows, ["shard", "to"], "gain", 16, "turn").orderBy("turn").collect()
    assert [r.turn for r in got] == list(range(160))
    gains = [min(r.gain, 63) for r in got]
    assert gains == sorted(gains, reverse=True)


def test_rounds_end_when_nobody_moves(spark):
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 0)], "node long, shard int")
    links = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "node long, hub long")
    plan = sharding.Plan(shards=3, slack=3.0, rounds=1000)
    got = {r.node: r.shard for r in sharding.propagate(labels, links, 4, plan).collect()}
    assert len(set(got.values())) == 1
    assert sharding.gathered(spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "node long, shard int"), spark.range(3).select(F.col("id").alias("node"), F.lit("x").alias("text_key")), 3).select("shard").distinct().count() == 1
