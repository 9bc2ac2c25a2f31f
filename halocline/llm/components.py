"""Connected components of a table of edges by contraction, for graphs of any shape and size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges a, b (long) that joins two nodes.

    In each round every node hooks to its smallest smaller neighbour, trees are flattened by pointer jumping, and edges
    are carried over to the roots; those within a tree go. Nodes that have no smaller neighbour are local minima, of
    which each round leaves a fraction. Only counts reach the driver.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    total = None
    while not edges.isEmpty():
        up = written(edges.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node"), "hooks")
        moved = True
        while moved:
            jump = up.select(F.col("node").alias("n"), F.col("root").alias("r"))
            flat = written(up.join(jump, F.col("root") == F.col("n"), "left").select("node", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "flat")
            moved = not flat.where("moved").isEmpty()
            discard(up)
            up = flat
        roots = up.select("node", "root")
        if total is None:
            total = written(roots, "total")
        else:
            step = roots.select(F.col("node").alias("n"), F.col("root").alias("r"))
            carried = total.join(step, F.col("root") == F.col("n"), "left").select("node", F.coalesce("r", "root").alias("root"))
            # roots of earlier rounds that hook now become nodes
            before, total = total, written(carried.unionByName(roots), "total")
            discard(before)
        a, b = (roots.select(F.col("node").alias(f"n{x}"), F.col("root").alias(f"r{x}")) for x in "ab")
        moved_edges = edges.join(a, F.col("a") == F.col("na"), "left").join(b, F.col("b") == F.col("nb"), "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        before, edges = edges, written(moved_edges.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(before, up)
    if total is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = total.select(F.col("root").alias("node"), "root").distinct()
    return total.unionByName(roots).select("node", F.col("root").alias("component"))
