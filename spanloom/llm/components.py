"""Connected components of a distributed edge list by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node) of every node in edges (a, b). Rounds grow with the logarithm of the nodes.

    In each round every node points to the neighbour (or itself) of least random priority and the edges are rewritten
    between what is pointed to; a node's neighbours are only aggregated, never gathered.
    """
    edges = materialize(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    steps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("n"))
        step = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", order("a"))["n"].alias("to"))
        step = materialize(step, "cc-step")
        a, b = step.toDF("a", "x"), step.toDF("b", "y")
        edges = materialize(edges.join(a, "a").join(b, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        steps.append(step)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    where = steps.pop()
    for step in reversed(steps):  # from the last round, with the fewest nodes, to the first
        where = materialize(step.join(where.toDF("to", "next"), "to", "left").select("node", F.coalesce("next", "to").alias("to")), "cc-map")
    least = where.groupBy("to").agg(F.min("node").alias("component"))
    return where.join(least, "to").select("node", "component")


def merged(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """groups (node, component), after the edges (a, b) are added: only what they join is worked on."""
    if edges.isEmpty():
        return groups
    a, b = groups.toDF("a", "x"), groups.toDF("b", "y")
    between = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    moved = materialize(components(between), "cc-moved")
    old = groups.join(moved.toDF("component", "next"), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return materialize(old.unionByName(moved.join(groups, "node", "left_anti")), "cc-groups")
