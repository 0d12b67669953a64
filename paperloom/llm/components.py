"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut, join_skewed

#: So few edges are contracted by one task, at whatever round they are that few.
SMALL = 4096


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every node's smallest node reachable, over all edges of the task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    if root:
        yield pd.DataFrame({"node": list(root), "to": [find(x) for x in root]})


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a, b``, both long).

    A round joins every node to its smallest neighbour, follows that once more and contracts
    the edges, so their number falls by a factor with each round and none is left after a
    logarithmic number of them; what is at most ``SMALL`` edges one task contracts. Labels stay in tables; the driver only asks whether edges
    remain. A component's label is a node of it. A hub's edges are pre-aggregated by
    ``min``, and joins on nodes deal a hub's rows over many tasks (``join_skewed``).
    """
    left = cut(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = cut(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    while (n := left.count()) > 0:
        if n <= SMALL:
            parent = cut(left.coalesce(1).mapInPandas(_contracted, "node long, to long"), "parents")
            labels = join_skewed(labels, parent.withColumnRenamed("node", "component"), "component", "left")
            return cut(labels.select("node", F.coalesce("to", "component").alias("component")), "labels")
        both = left.union(left.select("b", "a"))
        parent = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), "parents")
        hop = parent.select(F.col("node").alias("to"), F.col("to").alias("hop"))
        parent = cut(join_skewed(parent, hop, "to").select("node", F.col("hop").alias("to")), "parents")
        of = lambda c: parent.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        half = cut(join_skewed(left, of("a"), "a"), "edges")
        left = join_skewed(half, of("b"), "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        left = cut(left.distinct(), "edges")
        labels = cut(join_skewed(labels, of("component"), "component", "left").select("node", F.coalesce("component_to", "component").alias("component")), "labels")
    return labels
