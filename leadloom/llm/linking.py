"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, near


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, component): component is the smallest node that can be reached.

    links: (a, b), any order, repeats allowed; tables have no more than `parts` partitions. Every round each node takes the
    smallest label among its neighbours, then the label of that label, so
    chains shorten to half; it ends when no label changes. Each node is its own neighbour, so a round is
    one aggregate between two look-ups of labels, which are broadcast if they were counted to be few. Nothing is
    gathered on the driver. Links of a null are left out, as are those of a node to itself; no links give no rows."""
    real = links.filter("a <> b")  # nulls fail, too
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")])).alias("x")
    both = checkpoint(real.select(ends).select("x.*"), parts)
    # A node's first label is its smallest neighbour.
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), parts)
    nodes = labels.count()
    few = near(labels, nodes)
    while True:
        new = both.join(few.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("new"), F.min(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("before"))
        jump = few.select(F.col("node").alias("new"), F.col("component").alias("root"))
        after = checkpoint(new.join(jump, "new").select("node", F.least("new", "root").alias("component"), "before"), parts)
        changed = after.filter("component <> before").limit(1).count()
        labels = after.select("node", "component")
        few = near(labels, nodes)
        if not changed:
            return labels


def stars(label: DataFrame) -> DataFrame:
    """Links (a, b) of each node with the smallest of its component, for `components` of these and more links."""
    return label.select(F.col("node").alias("a"), F.col("component").alias("b"))
