"""Connected components of an edge table, by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.session import stable


def _undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge once, from its lesser to its greater end, without loops."""
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its least node), for every node that has an edge.

    A round gives every node the least of itself and its neighbours, follows these
    labels to their ends by doubling, and replaces both ends of each edge by their
    labels; edges inside a label vanish. At least half of the nodes vanish in a
    round, a group around its least node or a sorted chain is done in one. What a
    round leaves is stored; only whether labels moved and edges are left comes to
    the driver.
    """
    left = stable(_undirected(edges, a, b))
    found = None
    while found is None or not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        labels = stable(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
        while True:
            onward = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = stable(labels.join(onward, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")))
            if labels.where("moved").isEmpty():
                break
            labels = labels.drop("moved")
        if found is None:
            found = labels.select("node", F.col("label").alias("component"))
        else:
            onward = labels.select(F.col("node").alias("component"), "label")
            found = stable(found.join(onward, "component", "left").select("node", F.coalesce("label", "component").alias("component")))
        of_a, of_b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
        left = stable(_undirected(left.join(of_a, "a").join(of_b, "b"), "label_a", "label_b"))
    return found
