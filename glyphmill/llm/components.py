"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.session import settle_measured


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges`` (``a, b``); the label is the component's smallest node.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so paths shorten by halves. Both steps are aggregations and joins by
    node; labels are settled after every round. Nulls are no nodes.
    """
    known = edges.select("a", "b").dropna().filter("a <> b")
    both, _ = settle_measured(known.union(known.select("b", "a")).distinct(), "edges", n=F.count(F.lit(1)))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels, _ = settle_measured(labels, "labels", n=F.count(F.lit(1)))
    while True:
        own = labels.select(F.col("node").alias("b"), F.col("label").alias("theirs"))
        nearest = both.join(own, "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        lower = labels.join(nearest, "node").select("node", "label", F.least("label", "theirs").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("label").alias("jumped"))
        jumped = lower.join(jump, "lower", "left")
        moved = jumped.select("node", F.coalesce(F.least("lower", "jumped"), "lower").alias("label"), F.col("label").alias("before"))
        moved, measured = settle_measured(moved, "labels", moves=F.sum((F.col("label") != F.col("before")).cast("bigint")))
        labels = moved.select("node", "label")
        if not measured["moves"]:
            return labels
