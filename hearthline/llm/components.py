"""Connected components of a link table in a few rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import lookup, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest reachable id of every id in ``edges`` (``a, b`` long): ``node, comp``.

    Each round points every node at the smallest label next to it and then at that
    label's own label (hooking and pointer jumping); edges inside a component drop out.
    Self-links and repeated links are allowed. Every round aggregates before it
    shuffles, so a node with very many links costs one row per task.
    """
    labels = materialise(
        edges.select("a", "b").union(edges.select("b", "a")).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node")
    )
    live = edges.select("a", "b")
    while True:
        # pointer jumping
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("upper"))
        labels = materialise(labels.join(up, "comp", "left").select("node", F.coalesce("upper", "comp").alias("comp")))
        la = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        lb = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        live = materialise(
            live.join(la, "a").join(lb, "b").where("ca <> cb").select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct()
        )
        jump = labels.join(up, "comp").where("upper < comp").limit(1).count()
        if live.isEmpty():
            if not jump:
                return labels
            continue
        hook = live.groupBy("a").agg(F.min("b").alias("lower")).withColumnRenamed("a", "comp")
        labels = materialise(labels.join(hook, "comp", "left").select("node", F.least("comp", F.coalesce("lower", "comp")).alias("comp")))


def links_of_repeated_ids(rows: DataFrame, classes: DataFrame) -> DataFrame | None:
    """``a, b``: links between the nodes of one id, where rows repeat an id with other contents; None without any.

    ``rows`` has ``row, id, key`` and ``classes`` one ``node`` for a key.
    """
    named = rows.where("id is not null and key is not null").select("id", "key", "row", F.xxhash64("key").alias("kh"))
    twice = materialise(named.groupBy("id").agg(F.min("kh").alias("lo"), F.max("kh").alias("hi"), F.count(F.lit(1)).alias("w")).where("lo < hi").select("id", "w"))
    if twice.isEmpty():
        return None
    nodes = materialise(lookup(named, twice, "id", "w", "row").where("w is not null").select("id", "key").distinct().join(classes.select("key", "node"), "key"))
    low = materialise(nodes.groupBy("id").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("w")))
    return materialise(lookup(nodes.select("id", "node"), low, "id", "w", "node").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))


def relabelled(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``node, comp`` after ``links`` (``a, b``) between components."""
    joined = connected_components(links).select(F.col("node").alias("comp"), F.col("comp").alias("upper"))
    sizes = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("w"))
    upper = materialise(joined.join(sizes, "comp"))
    return materialise(lookup(comp, upper, "comp", "w", "node").select("node", F.coalesce("upper", "comp").alias("comp")))


def with_smallest_id(classes: DataFrame, comp: DataFrame) -> DataFrame:
    """``classes`` with ``component``: the smallest ``rep`` of all classes in a node's component, NULL if all are."""
    of_node = comp.join(classes.select("node", "rep"), "node")
    least = materialise(of_node.groupBy("comp").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("w")).where("w > 1"))
    renamed = lookup(comp, least, "comp", "w", "node").where("w is not null").select("node", "least")
    return classes.join(renamed, "node", "left").withColumn("component", F.coalesce("least", "rep")).drop("least")
