"""First come, first served among conflicting nodes: who is blocked by an accepted predecessor."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.components import connected_components
from gleaner.session import settled

FOLD_EDGES = 200_000  # what one task decides: its state is a set of blocked nodes
UNION_ROUNDS = 16


def blocked_nodes(edges: DataFrame) -> DataFrame:
    """(run, node) of nodes that follow an accepted neighbour; a node is accepted unless blocked.

    ``edges``: (run, later, earlier, turn), settled, where turn is the later node's place in
    the order and every earlier node has a lower one. Decisions never leave a connected
    component of a run. Components of up to FOLD_EDGES edges are decided by one walk each,
    in order, many of them in a task; larger ones in rounds of joins, as many as their
    longest chain. If all edges together are so few, components are not looked for.
    """
    if edges.limit(FOLD_EDGES + 1).count() <= FOLD_EDGES:
        return _walked(edges.withColumn("component", F.lit(0).cast("long")))
    src, dst = F.struct("run", F.col("later").alias("node")), F.struct("run", F.col("earlier").alias("node"))
    parts = connected_components(edges.select(src.alias("src"), dst.alias("dst")))
    parts = parts.select("node.run", F.col("node.node").alias("later"), F.xxhash64("component").alias("component"))
    placed = settled(edges.join(parts, ["run", "later"]))
    large = placed.groupBy("component").count().filter(F.col("count") > FOLD_EDGES).select("component")
    small = _walked(placed.join(large, "component", "left_anti"))
    return small.unionByName(_in_rounds(settled(placed.join(large, "component", "left_semi").drop("component", "turn"))))


def _walked(placed: DataFrame) -> DataFrame:
    schema = T.StructType([placed.schema["run"], T.StructField("node", placed.schema["later"].dataType)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocked, own = set(), None
        for batch in batches:
            kept = []
            columns = [batch[name].to_pylist() for name in ("component", "run", "later", "earlier")]
            for row, (component, run, later, earlier) in enumerate(zip(*columns, strict=True)):
                if component != own:
                    blocked, own = set(), component
                if (run, later) not in blocked and (run, earlier) not in blocked:
                    blocked.add((run, later))
                    kept.append(row)
            found = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([found["run"], found["later"]], names=["run", "node"])

    dealt = placed.repartition("component").sortWithinPartitions("component", "turn", "later")
    return dealt.select("component", "run", "later", "earlier").mapInArrow(walk, schema)


def _in_rounds(edges: DataFrame) -> DataFrame:
    """Whoever has no undecided predecessor is accepted and blocks its successors, until no edge is left."""
    waiting = edges.select("run", F.col("later").alias("earlier")).distinct()
    fresh = edges.select("run", "earlier").distinct().join(waiting, ["run", "earlier"], "left_anti")
    out = edges.select("run", F.col("later").alias("node")).limit(0)
    turn = 0
    while not edges.isEmpty():
        blocked = settled(edges.join(fresh, ["run", "earlier"], "left_semi").select("run", "later").distinct())
        gone = blocked.withColumnRenamed("later", "earlier")
        left = settled(edges.join(blocked, ["run", "later"], "left_anti").join(gone, ["run", "earlier"], "left_anti"))
        freed = edges.select("run", "later").distinct().join(blocked, ["run", "later"], "left_anti")
        freed = freed.join(left.select("run", "later").distinct(), ["run", "later"], "left_anti")
        fresh = settled(freed.withColumnRenamed("later", "earlier"))
        out = out.unionByName(blocked.withColumnRenamed("later", "node"))
        turn += 1
        if turn % UNION_ROUNDS == 0:
            out = settled(out)
        edges = left
    return out
