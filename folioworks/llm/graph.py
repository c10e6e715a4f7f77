"""Connected components of links between hashed ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.shared import stage


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of ``links`` (a, b: long); the component is one of its nodes.

    Each round merges every node into the smallest of its neighbours' targets (two steps at once) and keeps the
    distinct links between what remains, until none is left. Ids should be hashes: with random ids, nodes shrink by a
    constant factor a round, whatever the shape of the graph. Smallest neighbours are reduced on the tasks first, so a
    hub is no group, and every round is staged in the shared folder. No link or label comes to the driver.
    """
    edges = stage(
        links.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b"))
        near = near.select(F.col("a").alias("node"), F.least("a", "b").alias("target"))
        further = near.select(F.col("node").alias("target"), F.col("target").alias("next"))
        near = stage(near.join(further, "target").select("node", F.col("next").alias("target")))
        start, end = (near.select(F.col("node").alias(c), F.col("target").alias(f"{c}_")) for c in ("a", "b"))
        merged = edges.join(start, "a").join(end, "b").where(F.col("a_") != F.col("b_"))
        edges = stage(
            merged.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).distinct()
        )
        if labels is None:
            labels = near.withColumnRenamed("target", "component")
        else:
            step = near.withColumnRenamed("node", "component")
            labels = stage(
                labels.join(step, "component", "left").select(
                    "node", F.coalesce("target", "component").alias("component")
                )
            )
    return labels


def least_member(nodes: DataFrame, labels: DataFrame, value: str) -> DataFrame:
    """``nodes`` (node, value) with ``component_id``, the least value of its component; a node without links is its own."""
    joined = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min(value).alias("component_id"))
    return joined.join(least, "component").select("node", "component_id")
