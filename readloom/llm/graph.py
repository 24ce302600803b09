"""Connected components of an edge table, in DataFrame joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node reachable.

    Each round takes the least label among the neighbours, then the label's own label, so
    that paths shorten fast; rounds end when nothing changes. Every round is written to
    the shared folder. Messages to one node meet in map-side aggregation. Null ends are
    ignored; repeated edges and loops do no harm; no edges give no rows.
    """
    kept = edges.where("a IS NOT NULL AND b IS NOT NULL")
    both = util.stored(kept.select(F.col("a").alias("node"), F.col("b").alias("other")).union(kept.select("b", "a")).distinct())
    labels = util.stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        said = both.join(labels, "node").select(F.col("other").alias("node"), "label")
        near = said.union(labels).groupBy("node").agg(F.min("label").alias("next"))
        onward = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = near.join(onward, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("next"))
        new = util.stored(moved.join(labels, "node").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("changed")))
        util.dropped(labels)
        labels = new.select("node", "label")
        if new.where("changed").isEmpty():
            util.dropped(both)
            return labels
