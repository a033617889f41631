"""Patches of planes: cut, stitched, counted, paired with labels and transformed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendrovox.operators.sampling import draw, in_patches
from dendrovox.operators.views import Triple

Pair = tuple[int, int]


def to_patches(voxels: DataFrame, dims: Pair, patch: Pair, overlap: Pair) -> DataFrame:
    """Each voxel once for every patch (row, column) that holds it, at (py, px) there."""
    return in_patches(voxels, dims, patch, overlap).select("z", "row", "column", "py", "px", "v")


def stitched(patches: DataFrame, dims: Pair, patch: Pair, overlap: Pair, classes: int = 0, mask: DataFrame | None = None) -> DataFrame:
    """(z, y, x, v): patches put together from their valid insides, so no place comes twice.

    Half of an overlap belongs to each side; the first and last patch keep the plane's edge. With
    ``classes`` class ids are spread over 16 bits; places outside ``mask`` (z, y, x) become 0.
    """
    out, names = patches, {"y": "row", "x": "column"}
    for axis, d, p, o in zip("yx", dims, patch, overlap):
        step, count = p - o, max(1, -(-(d - o) // (p - o)))
        at, name = F.col(f"p{axis}"), F.col(names[axis])
        low = F.when(name == 0, 0).otherwise(o // 2)
        high = F.when(name == count - 1, p).otherwise(p - (o - o // 2))
        out = out.where((at >= low) & (at < high)).withColumn(axis, name * step + at)
    v = F.col("v") * (65535 // (classes - 1)) if classes > 1 else F.col("v")
    out = out.select("z", "y", "x", v.alias("v"))
    if mask is not None:
        out = out.join(mask.select("z", "y", "x", F.lit(True).alias("_in")), ["z", "y", "x"], "left").withColumn("v", F.when(F.col("_in"), F.col("v")).otherwise(0)).drop("_in")
    return out


def counts(planes: DataFrame, patch: Pair, overlap: Pair, batch: int, shard_bytes: int, voxel_bytes: int = 2) -> DataFrame:
    """``planes`` (height, width, ...) with how many patches, batches and shards they make."""
    each = [F.greatest(F.lit(1), F.ceil((F.col(c) - o) / float(p - o))) for c, p, o in zip(("height", "width"), patch, overlap)]
    out = planes.withColumn("patches", (each[0] * each[1]).cast("long"))
    return out.withColumns({"batches": F.expr(f"(patches + {batch - 1}) div {batch}"), "shards": F.ceil(F.col("height") * F.col("width") * voxel_bytes / float(shard_bytes)).cast("long")})


def paired(images: DataFrame, labels: DataFrame, number: str, context: int = 0) -> DataFrame:
    """(number, image, label, before_k, after_k): images and labels whose names hold the same number.

    ``number`` is a pattern whose first group is the number. Context images are those so many numbers
    away, null where there is none. Names without a number take no part.
    """
    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.regexp_extract("name", number, 1).try_cast("long").alias("number"), F.col("name").alias(name)).where("number is not null")

    pictures = keyed(images, "image")
    out = pictures.join(keyed(labels, "label"), "number")
    for k in range(1, context + 1):
        for side, shift in (("before", k), ("after", -k)):
            out = out.join(pictures.select((F.col("number") + shift).alias("number"), F.col("image").alias(f"{side}_{k}")), "number", "left")
    return out


def reversed_axes(voxels: DataFrame, dims: Triple, axes: str) -> DataFrame:
    return voxels.withColumns({a: n - 1 - F.col(a) for a, n in zip("zyx", dims) if a in axes})


def rotated(voxels: DataFrame, dims: Pair, theta: float) -> DataFrame:
    """(z, y, x, v): planes turned about their middle by ``theta``; every place takes the nearest voxel's value (labels stay labels)."""
    (ydim, xdim), c, s = dims, math.cos(theta), math.sin(theta)
    my, mx = (ydim - 1) / 2, (xdim - 1) / 2
    # A place takes a voxel within half a step on both axes, so it lies within 0.7072 of where the voxel turns to.
    low_y = F.ceil(my + c * (F.col("_y") - my) - s * (F.col("_x") - mx) - 0.7072)
    low_x = F.ceil(mx + s * (F.col("_y") - my) + c * (F.col("_x") - mx) - 0.7072)
    near = F.array(*[F.struct((low_y + i).cast("long").alias("y"), (low_x + j).cast("long").alias("x")) for i in (0, 1) for j in (0, 1)])
    asked = voxels.select("z", F.col("y").alias("_y"), F.col("x").alias("_x"), "v").withColumn("_p", F.explode(near)).select("z", "_p.y", "_p.x", "v", "_y", "_x")
    asked = asked.where(F.col("y").between(0, ydim - 1) & F.col("x").between(0, xdim - 1))
    from_y = F.round(my + c * (F.col("y") - my) + s * (F.col("x") - mx)).cast("long")
    from_x = F.round(mx - s * (F.col("y") - my) + c * (F.col("x") - mx)).cast("long")
    return asked.where((from_y == F.col("_y")) & (from_x == F.col("_x"))).select("z", "y", "x", "v")


def linear(voxels: DataFrame, alpha: float, beta: float, low: float, high: float) -> DataFrame:
    return voxels.withColumn("v", F.least(F.greatest(F.col("v") * alpha + beta, F.lit(low)), F.lit(high)))


def noisy(voxels: DataFrame, seed: int, sigma: float, low: float, high: float) -> DataFrame:
    """Gaussian noise by place and ``seed``, the same whenever it is drawn; cut to [low, high]."""
    place = F.concat_ws("/", *[F.col(a).cast("string") for a in "zyx"])
    one, two = draw(place, seed), draw(place, seed + 1)
    normal = F.sqrt(-2 * F.log(1 - one)) * F.cos(2 * math.pi * two)
    return voxels.withColumn("v", F.least(F.greatest(F.col("v") + sigma * normal, F.lit(low)), F.lit(high)))
