"""Connected components by repeated contraction, with written tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: long); component is the least node it reaches.

    Each round points every node to its least neighbour or itself, follows that
    pointer once more, and contracts the edges; the number of rounds grows with
    the logarithm of a component's size. Null ends and loops are no edges. No
    edges give an empty table. Edges are never gathered on the driver or in one
    task: a hub's edges are combined before the shuffle or split by the skew join.
    """
    live = scratch.save(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct()
    )
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mapping = None
    while True:
        point = both(live).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        point = scratch.save(point)
        hop = point.select(F.col("node").alias("to"), F.col("to").alias("then"))
        jumped = scratch.save(point.join(hop, "to").select("node", F.col("then").alias("to")))
        scratch.drop(point)
        if mapping is None:
            merged = jumped.select("node", F.col("to").alias("component"))
        else:
            moved = jumped.select(F.col("node").alias("component"), F.col("to").alias("then"))
            merged = mapping.join(moved, "component", "left").select("node", F.coalesce("then", "component").alias("component"))
        new_mapping = scratch.save(merged)
        step = live.join(jumped.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(jumped.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        contracted = scratch.save(step.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        scratch.drop(live, jumped, mapping)
        mapping, live = new_mapping, contracted
        if live.isEmpty():
            scratch.drop(live)
            return mapping
