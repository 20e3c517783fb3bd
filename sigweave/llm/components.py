"""Connected components of a graph given as rows of edges, by contraction: no step holds a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.shared import stash


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b (long). Returns node, component (the smallest node that it is connected with) for every node of an edge.

    Each round every node points to its smallest neighbour, pointers are followed twice, and the
    edges are drawn anew between the nodes pointed to; a star is done after one round, and a chain
    shrinks by a constant factor. Self-loops keep their node; nulls must be left out before.
    """
    edges = stash(edges.select("a", "b").distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up"))
        jump = up.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        up = stash(up.join(jump, "up").select("node", F.col("upper").alias("up")), "pointers")
        move = lambda side, end: up.select(F.col("node").alias(side), F.col("up").alias(end))
        edges = edges.join(move("a", "to_a"), "a").join(move("b", "to_b"), "b").where("to_a != to_b")
        edges = stash(edges.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        if labels is None:
            labels = up.withColumnRenamed("up", "component")
        else:
            labels = stash(labels.join(move("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
    return labels
