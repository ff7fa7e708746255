"""Connected components over an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (node, label), label being the smallest node
    that can be reached. Labels travel along edges and then along labels, so the
    distance they cover doubles; each round is written to the shared folder, and
    a node with very many edges is split by the join and pre-aggregated."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        near = labels.join(seen, "node").select("node", "label", F.least("label", "seen").alias("near"))
        far = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        now = staged(near.join(far, "near").select("node", F.least("near", "far").alias("label"), F.col("label").alias("was")))
        changed = not now.where("label <> was").isEmpty()
        discard(labels)
        if not changed:
            discard(both)
            return now.drop("was")
        labels = now
