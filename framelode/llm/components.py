"""Connected components of a link table, as rounds of joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attach, in_tasks, written


def contracted(links: DataFrame) -> DataFrame:
    """Links with the same components, but fewer: of the ends b of a node a, the smallest takes a and the others.

    For links (a, b) where few different b stand at each a, as in the forests that tasks return: a node has at most one
    root for each group that it was compared in. Roots recur, so most of the new links are the same.
    """
    ends = links.groupBy("a").agg(F.collect_set("b").alias("ends")).withColumn("least", F.least("a", F.array_min("ends")))
    return ends.select(F.explode(F.concat(F.array("a"), "ends")).alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b: long): the smallest node that it reaches.

    Every round a node takes the smallest label among its neighbours and then the label of its label, so labels cross
    long chains in about log2 of their length. Where no neighbour has a smaller label, linked nodes have equal ones, and
    these are final: a least node holds its own. Each round is written to the shared folder, which ends its lineage. A
    hub with very many links is answered by attach(), its sums are pre-aggregated. Nothing is collected but whether a
    label was lowered.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = written(both, "links")
    many = both.count()
    labels = both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("degree")).select(F.col("a").alias("node"), F.least("a", "least").alias("label"), "degree")
    labels = written(in_tasks(labels, many), "labels")
    while True:
        told = attach(both, labels.select(F.col("node").alias("b"), "degree", "label"), "b", "degree", "a").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(told, labels.node == told.a).select("node", F.least("label", "near").alias("label"), "degree", F.expr("near < label").alias("lowered"))
        lower = written(in_tasks(lower, many), "labels")
        if lower.where("lowered").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        of_label = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        holders = lower.groupBy("label").agg(F.count("*").alias("holders"))
        jumped = attach(lower, holders.join(of_label, "label").select("label", "holders", "next"), "label", "holders", "node")
        labels = written(in_tasks(jumped.select("node", F.least("label", "next").alias("label"), "degree"), many), "labels")
