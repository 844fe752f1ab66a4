"""Connected components by hooking to a random-order neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import settled


def _ordered(column: str, turn: int):
    """Order of nodes in one round; drawn anew each round, so that no chain runs along it."""
    return F.struct(F.xxhash64(F.lit(turn), F.col(column)), F.col(column).alias("node"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edge list (src, dst); the label is the smallest node.

    Each round hooks every node to the first node of its neighbourhood in that
    round's random order and contracts the edges, which removes a constant share
    of the nodes. Hub nodes only meet map-side combined minimums and joins whose
    other side has one row per node.
    """
    active = settled(
        edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .filter("src <> dst")
        .distinct()
    )
    assigned = active.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    assigned = assigned.withColumn("component", F.col("node"))
    turn = 0
    while not active.isEmpty():
        turn += 1
        ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
        both = active.select(F.inline(ends))
        first = F.least(F.first(_ordered("src", turn)), F.min(_ordered("dst", turn)))["node"]
        hooks = settled(both.groupBy("src").agg(first.alias("root")))
        assigned = assigned.join(hooks.select(F.col("src").alias("component"), "root"), "component", "left").select(
            "node", F.coalesce("root", "component").alias("component")
        )
        at_src = hooks.select("src", F.col("root").alias("a"))
        at_dst = hooks.select(F.col("src").alias("dst"), F.col("root").alias("b"))
        active = settled(
            active.join(at_src, "src")
            .join(at_dst, "dst")
            .filter("a <> b")
            .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
            .distinct()
        )
    assigned = settled(assigned)
    smallest = assigned.groupBy("component").agg(F.min("node").alias("label"))
    return assigned.join(smallest, "component").select("node", F.col("label").alias("component"))
