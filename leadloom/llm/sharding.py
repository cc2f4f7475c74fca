"""Sharding: balanced label propagation over linked documents.

Documents that are linked (here: equal texts; in general any table of links)
should share a shard, while all shards stay even. Every document starts in a
shard by hash. In each round a join tells every document how many of its
neighbours are in which shard; those who would gain ask to move (members and hubs in turns,
or the two ends of a link would swap for ever), and between
each two shards only as many move each way as the quotas of both allow, those
with most to gain first. Rounds end when nobody moves any more. At the end the order (shard, group) is cut into equal
runs, so the law `rows` holds exactly: counts differ by one at most. Groups lie whole in that order, so the cuts
split one group each at most, and no other group that fits into a shard's quota is split.

Groups of equal texts form trees of two levels, never cliques: members hang on the
smallest node of their salt, these on the smallest of the group; with as many salts as the root of
the number of rows, no node of a group of any size has more links than that by far. A group
that is larger than a shard's capacity is spread by the quotas.

Native: SQL functions, joins and aggregates only. After one pass over the texts
all tables are a few numbers per document. Ranks over all rows come from counts
per bucket (their number is fixed) and ranks inside buckets, not one big window.

Defined results: a null text counts as no bytes and null texts are equal; ties
go to smaller hashes; repeated doc_ids are placed one by one; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint


@dataclass(frozen=True)
class Plan:
    shards: int = 8
    #: Rounds at most; they end when neither members nor hubs move.
    rounds: int = 24
    #: Room of a shard during propagation, times an even share of the linked documents.
    slack: float = 1.1
    buckets: int = 512
    #: Groups with more than one in `hot` of all rows are ranked in parts.
    hot: int = 4096


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and a 128-bit key of the text, read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(text.cast("binary")).alias("text_key"),
    )


def equal_links(nodes: DataFrame, salts: int = 64) -> DataFrame:
    """A tree per group of equal texts: (node, hub), where a hub is the smallest node of a salt or of the group."""
    salted = nodes.select("text_key", "node", F.pmod(F.xxhash64("node"), F.lit(salts)).alias("salt"))
    heads = checkpoint(salted.groupBy("text_key", "salt").agg(F.min("node").alias("hub"), F.count("*").alias("n")))
    members = salted.join(heads.filter("n > 1"), ["text_key", "salt"]).select("node", "hub")
    tops = heads.groupBy("text_key").agg(F.min("hub").alias("top"), F.count("*").alias("n")).filter("n > 1")
    return members.unionByName(heads.join(tops.select("text_key", "top"), "text_key").select(F.col("hub").alias("node"), F.col("top").alias("hub"))).filter("node <> hub")


def _hash_shard(node: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(shards)).cast("int")


def _ranked(rows: DataFrame, by: list[str], gain: str, buckets: int, out: str) -> DataFrame:
    """Adds a rank from 0, by gain from the highest, then by hash. Ranks are counts per gain and bucket of the hash, and
    ranks inside; gains above 63 count as equal, so the number of these counts is fixed."""
    level = F.lit(63) - F.least(F.col(gain), F.lit(63))
    rows = rows.withColumn("_b", level * buckets + F.pmod(F.xxhash64("node"), F.lit(buckets)))
    counts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_b").orderBy(F.desc(gain), F.xxhash64("node"), "node")
    return rows.join(offsets, [*by, "_b"]).withColumn(out, F.col("_before") + F.row_number().over(inside) - 1).drop("_b", "_before")


def propagate(labels: DataFrame, links: DataFrame, total: int, plan: Plan) -> DataFrame:
    """labels: (node, shard) of linked nodes only. links: (node, hub)."""
    both = checkpoint(links.unionByName(links.select(F.col("hub").alias("node"), F.col("node").alias("hub"))))
    hubs = checkpoint(links.select(F.col("hub").alias("node")).distinct())
    still = 0  # turns in a row without a move
    for turn in range(plan.rounds):
        near = both.join(labels.select(F.col("node").alias("hub"), F.col("shard").alias("near")), "hub").groupBy("node", "near").agg(F.count("*").alias("votes"))
        # the most votes win; of equals, the one that most nodes can agree on: the smallest
        best = near.groupBy("node").agg(F.max(F.struct("votes", (-F.col("near")).alias("m"))).alias("b"), F.map_from_entries(F.collect_list(F.struct("near", "votes"))).alias("all"))
        asked = best.join(labels, "node").select("node", "shard", (-F.col("b.m")).cast("int").alias("to"), (F.col("b.votes") - F.coalesce(F.element_at("all", F.col("shard")), F.lit(0))).alias("gain"))
        # In turns, only members or only hubs move: if both ends of a link did, they would swap for ever.
        asked = checkpoint(asked.join(hubs, "node", "left_semi" if turn % 2 else "left_anti"))
        movers = asked.filter("to <> shard and gain > 0")
        # Quotas: a shard takes what others give back to it, and what room it has left.
        flow = movers.groupBy("shard", "to").agg(F.count("*").alias("asks"))
        back = flow.select(F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("asks").alias("returns"))
        sizes = labels.groupBy(F.col("shard").alias("to")).agg(F.count("*").alias("held"))
        n = F.lit(plan.shards)
        room = F.greatest(F.lit(0), F.floor(F.lit(plan.slack * total) / n) - F.coalesce("held", F.lit(0)))
        quota = (
            flow.join(back, ["shard", "to"], "left").join(sizes, "to", "left")
            .withColumn("room", room)
            .withColumn("spare", F.floor(F.col("room") * F.col("asks") / F.sum("asks").over(Window.partitionBy("to"))))
            .select("shard", "to", (F.least(F.col("asks"), F.coalesce("returns", F.lit(0)) + F.col("spare"))).alias("quota"))
        )
        ranked = _ranked(movers, ["shard", "to"], "gain", plan.buckets, "turn")
        moved = checkpoint(ranked.join(F.broadcast(quota), ["shard", "to"]).filter("turn < quota").select("node", F.col("to").alias("target")))
        if moved.limit(1).count():
            still, labels = 0, checkpoint(labels.join(moved, "node", "left").select("node", F.coalesce("target", "shard").alias("shard")))
        else:
            still += 1
        if still == 2:  # members and hubs
            break
    return labels


def gathered(labels: DataFrame, nodes: DataFrame, room: int) -> DataFrame:
    """labels, with what quotas have kept apart put where most of its group is, if the group fits into a shard's room; the cut that
    follows evens the sizes out. nodes: node, text_key of linked nodes."""
    held = labels.join(nodes, "node").groupBy("text_key", "shard").agg(F.count("*").alias("n"))
    whole = held.groupBy("text_key").agg(F.sum("n").alias("size"), F.count("*").alias("parts"), F.max(F.struct("n", (-F.col("shard")).alias("m"))).alias("most"))
    torn = whole.filter((F.col("parts") > 1) & (F.col("size") <= room)).select("text_key", (-F.col("most.m")).cast("int").alias("target"))
    moves = nodes.join(torn, "text_key").select("node", "target")
    return checkpoint(labels.join(moves, "node", "left").select("node", F.coalesce("target", "shard").alias("shard")))


def assign(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard, one row per
    row of `docs`."""
    # Rows get numbers of their own, so that repeated doc_ids stay apart; they are fixed by the checkpoint.
    nodes = checkpoint(described(docs).withColumn("node", F.monotonically_increasing_id()))
    total = nodes.count()
    linked = checkpoint(equal_links(nodes, math.isqrt(total) + 1))
    members = linked.select("node").unionByName(linked.select(F.col("hub").alias("node"))).distinct()
    start = members.select("node", _hash_shard(F.col("node"), plan.shards).alias("shard"))
    labels = propagate(checkpoint(start), linked, members.count() if total else 0, plan)
    labels = gathered(labels, nodes.join(members, "node").select("node", "text_key"), total // plan.shards)
    singles = nodes.select("node").join(labels, "node", "left_anti").withColumn("shard", _hash_shard(F.col("node"), plan.shards))
    placed = nodes.join(labels.withColumn("alone", F.lit(0)).unionByName(singles.withColumn("alone", F.lit(1))), "node")
    # One order of all rows: shard, linked documents in the middle of a shard's run, bucket of the group, group.
    group = F.xxhash64("text_key")
    placed = placed.withColumn("part", F.when(F.col("alone") == 0, F.lit(1)).otherwise(F.when(F.pmod(group, F.lit(2)) == 0, F.lit(0)).otherwise(F.lit(2)))).withColumn("b", F.pmod(group, F.lit(plan.buckets)))
    # A group with more than one in `hot` of all rows is ranked in 16 parts, one after the other; there are fewer than `hot` of them.
    often = nodes.groupBy(F.col("text_key").alias("hot_key")).agg(F.count("*").alias("n")).filter(F.col("n") * plan.hot > total).select("hot_key")
    placed = placed.join(F.broadcast(often), F.col("text_key") == F.col("hot_key"), "left").withColumn("hot_key", F.coalesce("hot_key", F.lit("")))
    placed = placed.withColumn("s", F.when(F.col("hot_key") == "", F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.lit(16))))
    order = ["shard", "part", "b", "hot_key", "s"]
    counts = placed.groupBy(*order).agg(F.count("*").alias("n"))  # a bounded number of rows: 8 x 3 x 512, and 8 x 16 for a hot group
    before = Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy(*order).orderBy("text_key", "node")
    ranked = placed.join(offsets, order).withColumn("at", F.col("before") + F.row_number().over(inside) - 1)
    k, extra = divmod(total, plan.shards)
    cut = extra * (k + 1)  # the first shards take one more row each
    shard = F.when(F.col("at") < cut, F.floor(F.col("at") / (k + 1))).otherwise(F.lit(extra) + F.floor((F.col("at") - cut) / max(k, 1)))
    first = F.when(shard <= extra, shard * (k + 1)).otherwise(F.lit(cut) + (shard - extra) * k)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), (F.col("at") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
