"""Connected components by smallest labels and pointer jumping, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stage_table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (src, dst); the component is its smallest node.

    Every round takes the smallest label of the neighbours and then the label of that label,
    so the rounds grow with the logarithm of the longest path. Labels are stored each round;
    nothing but the number of changes reaches the driver.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = stage_table(both.where("src <> dst").distinct(), "edges")
    labels = stage_table(
        both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("label")), "labels"
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "dst"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        target = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        moved = lower.join(target, "low").select("node", "label", F.least("low", "jump").alias("next"))
        moved = stage_table(moved, "labels")
        changed = moved.where("label <> next").count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
