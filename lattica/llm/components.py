"""Connected components by lowest label, with pointer jumping, over edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import materialised


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge: the least node that can be reached.

    Each round takes the least label among the neighbours and then the label of that label, and is written to
    the shared folder, so lineage stays short. Hot nodes are pre-aggregated before the shuffle; the joins
    read written tables directly, so that Spark can split their skewed partitions.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near")).filter("node != near")
    both = materialised(both.unionByName(both.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct(), "edges")
    labels = materialised(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("component").alias("seen"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        step = labels.join(jump, "component", "left").join(near, "node", "left")
        lowest = F.least("component", "next", "seen")  # nulls are skipped
        new = materialised(step.select("node", lowest.alias("component"), (lowest < F.col("component")).alias("moved")), "labels")
        moved, labels = new.filter("moved").limit(1).count(), new.select("node", "component")
        if not moved:
            return labels
