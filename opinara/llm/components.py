"""Connected components of a graph of links, by contraction, without any group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm._shared import settled, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is one node of the node's component. No tables stay but the result's."""
    return settled(lambda: _contract(edges), "components")


def _contract(edges: DataFrame) -> DataFrame:
    """Each round points every node to its smallest neighbour (or itself), follows these pointers to their end by
    doubling, and replaces the nodes of the edges by where they lead; edges inside a tree go. At least half of the
    trees merge in a round, so rounds are logarithmic. Minima combine before the shuffle, so a node with very many
    links is no hot spot; links and labels never reach the driver, only counts do.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = written(nodes.select("node", F.col("node").alias("root")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "pointers")
        while True:
            to = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            jumped = written(up.join(to, "up", "left").select("node", F.coalesce("next", "up").alias("up"), (F.coalesce("next", "up") != F.col("up")).alias("moved")), "pointers")
            up = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        labels = written(labels.join(up.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        left = edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("p")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("r")), "b")
        edges = written(left.where("p <> r").select(F.least("p", "r").alias("a"), F.greatest("p", "r").alias("b")).distinct(), "edges")
    return labels
