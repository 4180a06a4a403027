"""Connected components of an edge list, by Spark joins.

Labels spread to neighbours and then jump to the label of their label, so a
chain of n nodes needs about log(n) rounds; each round is written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node id
    that it is connected with.  Only the number of labels that changed in a
    round comes to the driver.  A node that stands in a third of all edges is
    reduced within the tasks first (min is a partial aggregate)."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(),
                 "edges")
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
                   .select(F.col("a").alias("node"), "root"), "labels")
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("node").alias("b"), "root"), "b")
                .groupBy("a").agg(F.min("root").alias("seen"))
                .select(F.col("a").alias("node"), "seen"))
        step = labels.join(near, "node").select(
            "node", F.col("root").alias("was"), F.least("root", "seen").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = stage(step.join(jump, "root", "left")
                      .select("node", F.least("root", F.coalesce("far", "root")).alias("root"),
                              "was"), "labels")
        moved = after.where("root <> was").agg(F.count("*")).first()[0]
        labels = after.select("node", "root")
        if not moved:
            return labels
    raise RuntimeError(f"components: labels still moved after {max_rounds} rounds")
