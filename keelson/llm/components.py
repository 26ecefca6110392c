"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


#: So many edges at most are solved in one task; they take some 100 MB there.
ONE_TASK = 500_000


def union_find(rows):
    """Arrow function over all edges in one task: (node, root)."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in rows:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([find(x) for x in nodes], pa.binary())], names=["node", "root"])


def connected_components(edges: DataFrame, rounds: int = 200, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node of the edges (a, b; binary); root is the least node of its component.

    Large stars and small stars alternate until nothing changes.  Each half round
    is one shuffle of the edges, and its result goes to the shared folder.  A
    table of at most `one_task` edges, as counted, takes one task instead, with
    the same result.  A graph that does not settle in `rounds` is an error.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    if now.count() <= one_task:
        return now.coalesce(1).mapInArrow(union_find, "node binary, root binary")
    # What a task holds of the graph first shrinks to a star for each of its parts.
    now = materialize(now.mapInArrow(union_find, "node binary, root binary").where("node <> root").toDF("a", "b").distinct(), "edges")
    sums = None
    for _ in range(rounds):
        # Large star: the greater neighbours of a node go to its least neighbour (or itself).
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its lesser neighbours go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = materialize(small.where("a <> b").distinct(), "edges")
        discard(now)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == state:
            break
        sums = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
