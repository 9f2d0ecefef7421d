"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """node and comp (smallest node reachable) of every node of the edges ``a``, ``b``.

    Union-find by labels: in each round every node takes the smallest label around it and then the label of its
    label, so chains shorten by jumps. A node of many edges costs partial aggregates only; each round is checkpointed,
    and nothing but the number of changes comes to the driver.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("comp"))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("to")).agg(F.min("comp").alias("least"))
        step = labels.join(around, labels["node"] == around["to"]).select("node", F.col("comp").alias("old"), F.least("comp", "least").alias("comp"))
        step = cut_lineage(step)
        jump = step.select(F.col("node").alias("root"), F.col("comp").alias("further"))
        after = cut_lineage(step.join(jump, step["comp"] == jump["root"]).select("node", "old", F.least("comp", "further").alias("comp")))
        labels = after.select("node", "comp")
        if after.filter("old <> comp").limit(1).count() == 0:
            return labels
