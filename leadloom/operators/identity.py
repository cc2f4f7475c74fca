"""Connected keys: which keys name the same entity, from records that carry several of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import shared_folder


def _stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder."""
    path = shared_folder(df.sparkSession, f"identity-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def connected(keys: DataFrame) -> DataFrame:
    """key, label: the least key (as text) that can be reached through records. keys: an array of texts per record; nulls and
    repeats in it are allowed.

    A record links its least key with its others, and equal links are one from the start, so a key that a third of all records
    have is one row for each key it stands beside. In each round every key takes the least label of its neighbours, then the label of that
    label, so chains shorten to half; it ends when no label changes."""
    own = keys.select(F.sort_array(F.array_distinct(F.array_compact("keys"))).alias("k")).filter(F.size("k") > 0)
    links = _stored(own.select(F.col("k")[0].alias("a"), F.explode("k").alias("b")).distinct())
    both = _stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = _stored(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("label")))
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        root = labels.select(F.col("key").alias("near"), F.col("label").alias("root"))
        after = _stored(labels.join(near, "key").join(root, "near").select("key", F.least("label", "root").alias("label"), (F.least("label", "root") < F.col("label")).alias("changed")))
        labels = after.select("key", "label")
        if not after.filter("changed").limit(1).count():
            return labels
