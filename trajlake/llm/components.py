"""Connected components of a table of links, by contraction: no row of it passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm._shared import drop, materialize


def components(links: DataFrame) -> DataFrame:
    """node and root for each node of links (a, b): root is the same for nodes that links join, and one of them.

    A round hangs each node on its least neighbour and then draws the links between what hangs on different nodes, so the
    links shrink until none is left. Links of a node with itself and repeated links change nothing.
    """
    ways = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(ways.distinct(), "component_edges")
    labels = materialize(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct(), "component_labels")
    edges, spent = materialize(edges.filter("a <> b"), "component_edges"), edges
    drop(spent)
    while not edges.isEmpty():
        up = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        up = materialize(up, "component_parents")
        # Twice up the tree, so that chains of parents halve.
        twice = up.alias("u").join(up.alias("v"), F.col("u.p") == F.col("v.a"), "left").select(F.col("u.a").alias("a"), F.coalesce("v.p", "u.p").alias("p"))
        jump = materialize(twice, "component_parents")
        moved = labels.join(jump, labels["root"] == jump["a"], "left").select("node", F.coalesce("p", "root").alias("root"))
        left, right = jump.select("a", F.col("p").alias("pa")), jump.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        drawn = edges.join(left, "a").join(right, "b").filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        moved, drawn = materialize(moved, "component_labels"), materialize(drawn, "component_edges")
        drop(labels, edges, up, jump)
        labels, edges = moved, drawn
    return labels
