"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendrovox.plans.durable import materialize


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours; ``edges`` holds (u, v) with each neighbour of u."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of u to the least node around u."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least_neighbour(both), "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Connect u and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least_neighbour(down), "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = joined.select("u", F.col("m").alias("v"))
    return moved.union(own).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one node only, and that one on none: the edges are stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below = 1 and above = 1)").isEmpty()


#: Edges that one task contracts; a table of n edges is dealt to n / EDGES_A_TASK tasks. Smaller tables are dealt to
#: tasks of a few thousand, up to ``LEAST_TASKS`` of them, so that no task sees a whole table of any size that matters.
EDGES_A_TASK = 200_000
LEAST_EDGES, LEAST_TASKS = 4096, 8


def least_heads(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the nodes 0..n-1 that each of them is joined to by the edges a - b."""
    head = np.arange(n)
    while len(a):
        ha, hb = head[a], head[b]
        apart = ha != hb
        if not apart.any():
            break
        a, b, ha, hb = a[apart], b[apart], ha[apart], hb[apart]
        np.minimum.at(head, np.maximum(ha, hb), np.minimum(ha, hb))
        while (head[head] != head).any():
            head = head[head]
    return head


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars around the least node of each component that they make among themselves."""
    table = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    head = least_heads(at[: len(u)], at[len(u) :], len(nodes))
    moved = np.flatnonzero(head != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[head[moved]])], names=["u", "v"])


def contracted(edges: DataFrame, count: int) -> DataFrame:
    """Fewer edges of the same components: each task joins what its own edges join before anything is shuffled."""
    tasks = max(-(-count // EDGES_A_TASK), min(LEAST_TASKS, -(-count // LEAST_EDGES)), 1)
    return edges.select("u", "v").coalesce(tasks).mapInArrow(_contract, "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component: the least node reachable.

    ``edges`` has columns u and v (long, not null); loops and repeated edges do no harm. Edges are
    contracted inside tasks, then joined across tasks by both stars, and so on until all are stars.
    The stars aggregate before they join, so a node with very many edges is no single task, and each
    round is checkpointed in shared storage. Every round before the last moves some edge to a smaller
    node, so they end.
    """
    plain = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    state = materialize(plain.where("u <> v").distinct())
    count = state.count()
    state = materialize(contracted(state, count))
    while not _settled(state):
        state = materialize(contracted(small_star(large_star(state)), count))
    leaves = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())
