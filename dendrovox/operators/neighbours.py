"""Neighbourhoods of voxels as joins with a small table of offsets."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many axes may change for 6, 18 and 26 neighbours.
REACH = {6: 1, 18: 2, 26: 3}


def offsets(connectivity: int, forward: bool = False) -> list[tuple[int, int, int]]:
    """Steps to the neighbours; ``forward``: one of each opposite pair."""
    steps = [d for d in product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, d)) <= REACH[connectivity]]
    return [d for d in steps if d > (0, 0, 0)] if forward else steps


def neighbour_pairs(voxels: DataFrame, connectivity: int, forward: bool = False, keep: tuple[str, ...] = ("z", "y", "x")) -> DataFrame:
    """Pairs of neighbouring voxels: columns of the first as they are, those of the second with ``n_``.

    Each voxel sends one row a step to the place it steps to, and places are equi-joined.
    """
    steps = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(d, ("dz", "dy", "dx"))]) for d in offsets(connectivity, forward)])
    sent = voxels.withColumn("_step", F.explode(steps)).withColumns({f"n_{a}": F.col(a) + F.col(f"_step.d{a}") for a in "zyx"}).drop("_step")
    others = voxels.select(*[F.col(c).alias(f"n_{c}") for c in dict.fromkeys((*"zyx", *keep))])
    return sent.join(others, ["n_z", "n_y", "n_x"])


def neighbour_links(voxels: DataFrame, dims: tuple[int, int, int], connectivity: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(u, v, axes, *keep, *n_keep): addresses of neighbouring voxels (id, z, y, x), both ways, and how many axes a step changes.

    Only one step of each opposite pair is sent, by address, and pairs are turned round where they met.
    """
    _, ydim, xdim = dims
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit((dz * ydim + dy) * xdim + dx).cast("long").alias("by"), F.lit(abs(dz) + abs(dy) + abs(dx)).alias("axes")) for dz, dy, dx in offsets(connectivity, forward=True)])
    inside = (F.col("y") + F.col("_s.dy")).between(0, ydim - 1) & (F.col("x") + F.col("_s.dx")).between(0, xdim - 1)
    sent = voxels.select("id", "y", "x", *keep, F.explode(steps).alias("_s")).where(inside).select(F.col("id").alias("u"), (F.col("id") + F.col("_s.by")).alias("v"), F.col("_s.axes").alias("axes"), *keep)
    met = sent.join(voxels.select(F.col("id").alias("v"), *[F.col(c).alias(f"n_{c}") for c in keep]), "v")
    there = F.struct("u", "v", "axes", *keep, *[f"n_{c}" for c in keep])
    back = F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "axes", *[F.col(f"n_{c}").alias(c) for c in keep], *[F.col(c).alias(f"n_{c}") for c in keep])
    return met.select(F.explode(F.array(there, back)).alias("_l")).select("_l.*")
