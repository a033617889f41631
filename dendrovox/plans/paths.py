"""Walks towards the root of every node of a forest, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrovox.plans.durable import materialize


def climb(nodes: DataFrame, value: Column, stop: Column, node: str = "node_id", parent: str = "parent_id", rounds: int = 64) -> DataFrame:
    """(node, top, total, steps): the first node at or above ``node`` where ``stop`` holds.

    ``total`` sums ``value`` over the nodes from ``node`` up to, but without, ``top``; ``steps``
    counts them. Each round doubles the distance, so a chain of n nodes takes log2(n) joins.
    """
    halted = F.coalesce(stop, F.lit(True))
    state = nodes.select(
        F.col(node), F.when(halted, F.col(node)).otherwise(F.col(parent)).alias("top"),
        F.when(halted, F.lit(0) * value).otherwise(value).alias("total"), F.when(halted, 0).otherwise(1).cast("long").alias("steps"), halted.alias("done"),
    )
    state = materialize(state)
    for _ in range(rounds):
        if state.where("not done").isEmpty():
            return state.drop("done")
        above = state.select(F.col(node).alias("top"), F.col("top").alias("_top"), F.col("total").alias("_total"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        moved = state.where("not done").join(above, "top", "left")
        moved = moved.select(
            node, F.coalesce("_top", "top").alias("top"), (F.col("total") + F.coalesce("_total", F.lit(0) * F.col("total"))).alias("total"),
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_done", F.lit(True)).alias("done"),
        )
        state = materialize(state.where("done").unionByName(moved))
    raise RuntimeError(f"the walk did not end in {rounds} rounds: the parents form a cycle")
