"""Connected components of a graph of edges, without moving the graph to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); a component is named by its smallest node.

    Each round points every node to its smallest neighbour (or itself), follows pointers a few
    steps, and contracts the graph: edges between the nodes pointed to are all that is left for
    the next round, at most half the nodes. The rounds' pointers, put together, name the components.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    pointers = []
    for _ in range(most_rounds):
        to = both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("to"))
        to = cut_lineage(follow(follow(cut_lineage(to, "near"))), "pointers")
        pointers.append(to)
        left = both.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        ends = left.join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        both = cut_lineage(ends.where(F.col("x") != F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        if both.limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    named = pointers[-1].withColumnRenamed("to", "component")
    for to in reversed(pointers[:-1]):
        named = to.join(named.select(F.col("node").alias("to"), "component"), "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return cut_lineage(named, "components")


def follow(to: DataFrame) -> DataFrame:
    """Each pointer led on by the pointer it leads to."""
    return to.join(to.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to"))
