"""Connected components of a link table in a few rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.plans.tables import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest reachable id of every id in ``edges`` (``a, b`` long): ``node, comp``.

    Each round points every node at the smallest label next to it and then at that
    label's own label (hooking and pointer jumping); edges inside a component drop out.
    Self-links and repeated links are allowed. Every round aggregates before it
    shuffles, so a node with very many links costs one row per task.
    """
    edges = edges.select("a", "b")
    labels = cut(edges.union(edges.select("b", "a")).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node"))
    live = edges
    while True:
        # pointer jumping
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("upper"))
        labels = cut(labels.join(up, "comp", "left").select("node", F.coalesce("upper", "comp").alias("comp")))
        la = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        lb = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        live = cut(live.join(la, "a").join(lb, "b").where("ca <> cb").select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct())
        jump = not labels.join(up, "comp").where("upper < comp").isEmpty()
        if live.isEmpty():
            if not jump:
                return labels
            continue
        hook = live.groupBy("a").agg(F.min("b").alias("lower")).withColumnRenamed("a", "comp")
        labels = cut(labels.join(hook, "comp", "left").select("node", F.least("comp", F.coalesce("lower", "comp")).alias("comp")))
