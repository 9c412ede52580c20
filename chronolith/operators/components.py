"""Connected components by label propagation with pointer jumping; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``(node, label)``: the least node of each linked node's component, for links ``(a, b)``.

    Only nodes with a link take part. Labels fall along links and jump along labels, so the number of rounds grows
    with the logarithm of a component's diameter.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.distinct(), "links")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        around = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        lower = labels.join(around, "node").select("node", "label", F.least("label", "least").alias("lower"))
        over = labels.select(F.col("node").alias("over"), F.col("label").alias("top"))
        jumped = lower.join(over, lower.lower == over.over).select("node", F.least("lower", "top").alias("lower"), "label")
        step = materialize(jumped, "labels")
        labels = step.select("node", F.col("lower").alias("label"))
        if step.where("lower <> label").isEmpty():
            return labels
