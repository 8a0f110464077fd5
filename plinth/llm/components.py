"""Connected components of an edge table by smallest labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge: the smallest node it can reach.

    Each round takes the smallest label among the neighbours and then the label of that label;
    rounds go down with the logarithm of the longest path.  Every table is written to the shared
    folder, and the joins read both sides from there, so that AQE can split the partition of a
    node that very many edges or labels name.
    """
    ways = F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b")))
    both = staged(edges.select(F.inline(ways)).where("a <> b").distinct(), "edges")  # what finds the edges runs once
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        told = both.join(labels, both["a"] == labels["node"]).groupBy("b").agg(F.min("label").alias("m"))
        nearer = staged(labels.join(told, labels["node"] == told["b"], "left")
                        .select("node", F.least("label", "m").alias("label"), F.col("label").alias("old")), "nearer")
        jump = nearer.select(F.col("node").alias("root"), F.col("label").alias("next"))
        moved = staged(nearer.join(jump, nearer["label"] == jump["root"]).select("node", F.col("next").alias("label"), "old"), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")


class Forest:
    """Disjoint sets of the members of one group in one task."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
