"""Patches, plane contexts and repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patch_grid(spark, dims: tuple[int, int], patch: tuple[int, int], overlap: tuple[int, int]) -> DataFrame:
    """(row, column, y0, x0): patches that cover a plane, each shifted by patch - overlap."""
    steps = [p - o for p, o in zip(patch, overlap)]
    rows, columns = (max(1, -(-(d - o) // s)) for d, o, s in zip(dims, overlap, steps))
    grid = spark.range(rows * columns)
    return grid.select(F.expr(f"id div {columns}").alias("row"), (F.col("id") % columns).alias("column")).withColumns({"y0": F.col("row") * steps[0], "x0": F.col("column") * steps[1]})


def in_patches(voxels: DataFrame, dims: tuple[int, int], patch: tuple[int, int], overlap: tuple[int, int]) -> DataFrame:
    """Each voxel once for every patch that holds it, with its place (py, px) there."""
    out = voxels
    for axis, d, p, o, name in zip("yx", dims, patch, overlap, ("row", "column")):
        step, count = p - o, max(1, -(-(d - o) // (p - o)))
        first = F.greatest(F.lit(0), F.expr(f"cast(ceil(({axis} - {p} + 1) / {step}) as bigint)"))
        last = F.least(F.lit(count - 1), F.expr(f"{axis} div {step}"))
        out = out.where(first <= last).withColumn(name, F.explode(F.sequence(first, last))).withColumn(f"p{axis}", F.col(axis) - F.col(name) * step)
    return out


def plane_context(planes: DataFrame, reach: int, by: str = "z", value: str = "v") -> DataFrame:
    """Each plane with the values of the ``reach`` planes before and after it; 0 beyond the ends.

    ``planes`` has one row for each plane; planes are counted, not spaced, by their order.
    """
    others = F.explode(F.array(*[F.lit(i) for i in range(-reach, reach + 1)]))
    sent = planes.select((F.col(by)).alias("_from"), F.col(value).alias("_value"), others.alias("_step")).withColumn(by, F.col("_from") - F.col("_step"))
    parts = sent.groupBy(by).agg(*[F.max(F.when(F.col("_step") == i, F.col("_value"))).alias(f"at_{i + reach}") for i in range(-reach, reach + 1)])
    joined = planes.join(parts, by, "left")
    return joined.withColumns({f"at_{i}": F.coalesce(f"at_{i}", F.lit(0)) for i in range(2 * reach + 1)})


def draw(key: Column, seed: int) -> Column:
    """A repeatable draw from [0, 1) for each key."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), key)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def away_from_edges(points: DataFrame, dims: dict[str, tuple[float, float]], margin: float) -> DataFrame:
    test = F.lit(True)
    for axis, (low, high) in dims.items():
        test &= (F.col(axis) >= low + margin) & (F.col(axis) < high - margin)
    return points.where(test)


def centred_crop(at: Column, size: int, dim: int) -> tuple[Column, Column]:
    """Offset and extent of a crop of ``size`` around a place, cut at the ends of the axis."""
    low = F.greatest(F.lit(0), at - size // 2)
    return low, F.least(F.lit(dim), at - size // 2 + size) - low


def class_weights(labels: DataFrame, column: str) -> DataFrame:
    """exp(share) of each class."""
    counts = labels.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", F.exp(F.col("n") / F.sum("n").over(Window.partitionBy())))


def confusion(pairs: DataFrame, truth: str, guess: str) -> DataFrame:
    """tp, fp, fn, IoU, precision and recall of each class."""
    guessed = pairs.groupBy(F.col(guess).alias("class")).agg(F.count(F.lit(1)).alias("guessed"), F.sum((F.col(guess) == F.col(truth)).cast("long")).alias("tp"))
    true = pairs.groupBy(F.col(truth).alias("class")).agg(F.count(F.lit(1)).alias("true"))
    both = true.join(guessed, "class", "full").na.fill(0)
    tp, fp, fn = F.col("tp"), F.col("guessed") - F.col("tp"), F.col("true") - F.col("tp")
    return both.select("class", "tp", fp.alias("fp"), fn.alias("fn"), (tp / (tp + fp + fn)).alias("iou"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"))
