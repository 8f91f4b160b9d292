"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encircle.llm.shared import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``a, b``; the component is its smallest node.

    Every node takes the smallest label among itself and its neighbours and then the label of its
    label, until nothing changes.  Labels and edges stay distributed; each round is written to the
    shared folder, and only the number of changes reaches the driver.  An empty graph gives an
    empty table; repeated pairs and loops do no harm; pairs with a null are no pairs.
    """
    pairs = edges.where("a is not null and b is not null").select("a", "b")
    both = written(pairs.union(pairs.select("b", "a")), "edges")
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")),
        "labels",
    )
    while True:
        seen = both.join(labels, both.b == labels.node).select(both.a, "component")
        lowest = seen.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_low"))
        moved = labels.join(lowest, "node").select(
            "node", F.col("component").alias("_old"), F.least("component", "_low").alias("component")
        )
        roots = moved.select(F.col("node").alias("_root"), F.col("component").alias("_up"))
        jumped = moved.join(roots, moved.component == roots._root).select(
            "node", "_old", F.least("component", "_up").alias("component")
        )
        step = written(jumped, "labels")
        labels = step.select("node", "component")
        if step.where("component <> _old").isEmpty():
            return labels
