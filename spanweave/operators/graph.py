"""Connected components of an edge list, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its least node) for every end of ``edges``.

    Every round takes the least label of the neighbours, pre-aggregated, and then the label
    of that label, so labels travel over doubling distances. Null ends are left out; loops
    and repeated edges change nothing; no edges give no rows."""
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = cut(ends.union(ends.select("b", "a")).union(ends.select("a", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    while True:  # labels only fall, so this ends
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        joined = labels.join(heard, labels.node == heard.a).select("node", "label", F.least("label", "heard").alias("new"))
        up = joined.select(F.col("node").alias("at"), F.col("new").alias("above"))
        nxt = cut(joined.join(up, joined.new == up.at).select("node", "label", F.least("new", "above").alias("new")))
        labels = nxt.select("node", F.col("new").alias("label"))
        if nxt.where("label <> new").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
