"""Views of volumes: blocks with offsets, extents and strides at a level of the pyramid."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
Triple = tuple[int, int, int]


@dataclass(frozen=True)
class Block:
    """Selection in z, y, x order; an extent of 0 reaches to the end of the axis."""

    offsets: Triple = (0, 0, 0)
    extents: Triple = (0, 0, 0)
    strides: Triple = (1, 1, 1)


@dataclass(frozen=True)
class View:
    """A block at a level, in the coordinates of that level (``local``) and of level 0 (``whole``)."""

    level: int
    dims: Triple
    local: Block
    whole: Block

    @property
    def strided_dims(self) -> Triple:
        return tuple(strided_extent(e, s) for e, s in zip(self.local.extents, self.local.strides))

    def memory_bytes(self, channels: int = 1, voxel_bytes: int = 2) -> int:
        z, y, x = self.strided_dims
        return channels * voxel_bytes * z * y * x

    def entirely_outside(self) -> bool:
        return any(o >= d for o, d in zip(self.local.offsets, self.dims))

    def partially_outside(self) -> bool:
        return any(o + (n - 1) * s >= d for o, n, s, d in zip(self.local.offsets, self.strided_dims, self.local.strides, self.dims))

    def dims_inside(self) -> Triple:
        return tuple(max(0, min(n, strided_extent(d - o, s))) for o, n, s, d in zip(self.local.offsets, self.strided_dims, self.local.strides, self.dims))


def strided_extent(extent: int, stride: int) -> int:
    return -(-extent // stride)


def residual_stride(extent: int, stride: int) -> int:
    """How far the last step of a stride reaches past the extent."""
    return max(strided_extent(extent, stride) * stride - extent, 0)


def select_view(level_dims: list[Triple], block: Block, level: int = 0, local: bool = False) -> View:
    """The view of ``block``, given at level 0 or, if ``local``, at ``level`` itself."""
    ratios = tuple(a // b for a, b in zip(level_dims[0], level_dims[level]))
    if local:
        dims = level_dims[level]
        own = replace(block, extents=tuple(e or d - o for e, d, o in zip(block.extents, dims, block.offsets)))
        whole = Block(*(tuple(f(v, r) for v, r in zip(values, ratios)) for f, values in ((lambda v, r: v * r, own.offsets), (lambda v, r: v * r, own.extents), (lambda v, r: v * r if v > 1 else v, own.strides))))
        return View(level, dims, own, whole)
    if any(o >= d for o, d in zip(block.offsets, level_dims[0])):
        raise ValueError("the block begins outside the volume")
    whole = replace(block, extents=tuple(e or d - o for e, d, o in zip(block.extents, level_dims[0], block.offsets)))
    own = Block(*(tuple(max(least, v // r) for v, r in zip(values, ratios)) for least, values in ((0, whole.offsets), (1, whole.extents), (1, whole.strides))))
    return View(level, level_dims[level], own, whole)


def in_block(block: Block, axes: tuple[str, ...] = AXES) -> Column:
    """Predicate of the voxels that a block selects; plain comparisons, so scans can skip on it."""
    test = F.lit(True)
    for axis, o, e, s in zip(axes, block.offsets, block.extents, block.strides):
        test &= (F.col(axis) >= o) & (F.col(axis) < o + e)
        if s > 1:
            test &= (F.col(axis) - o) % s == 0
    return test


def read_view(voxels: DataFrame, view: View, channels: list[int] | None = None) -> DataFrame:
    """Voxels of a view in its own coordinates; ``channels`` keeps the given order as column c."""
    chosen = voxels.where(in_block(view.local))
    if channels is not None:
        chosen = chosen.where(F.col("c").isin(channels)).withColumn("c", F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("c")) - 1)
    return chosen.withColumns({a: F.expr(f"({a} - {o}) div {s}") for a, o, s in zip(AXES, view.local.offsets, view.local.strides)})


def padded_view(voxels: DataFrame, view: View, background: int = 0) -> DataFrame:
    """Every place of a view; those without a voxel or outside the volume hold the background."""
    z, y, x = view.strided_dims
    grid = voxels.sparkSession.range(z * y * x).select(F.expr(f"id div {y * x}").alias("z"), F.expr(f"(id div {x}) % {y}").alias("y"), (F.col("id") % x).alias("x"))
    return grid.join(read_view(voxels, view), list(AXES), "left").withColumn("v", F.coalesce("v", F.lit(background)))


def copy_block(source: DataFrame, target: DataFrame, read: Block, write: Block) -> DataFrame:
    """``target`` with the voxels of ``read`` put at the places of ``write``, stride by stride."""
    moved = source.where(in_block(read)).withColumns({a: F.expr(f"({a} - {o}) div {s} * {t} + {p}") for a, o, s, p, t in zip(AXES, read.offsets, read.strides, write.offsets, write.strides)})
    return target.where(~in_block(write)).unionByName(moved)


def set_block(voxels: DataFrame, block: Block, value: int) -> DataFrame:
    return voxels.withColumn("v", F.when(in_block(block), F.lit(value)).otherwise(F.col("v")))


def volumes_differ(a: DataFrame, b: DataFrame, parts: int | None = None) -> DataFrame:
    """Voxels that only one side has, as often as it has more of them (no rows: equal).

    Both sides are counted at once, in ``parts`` partitions if they are given.
    """
    both = a.withColumn("__n", F.lit(1).cast("long")).union(b.withColumn("__n", F.lit(-1).cast("long")))
    keys = [f"`{c}`" for c in a.columns]
    if parts:
        both = both.repartition(parts, *keys)
    more = both.groupBy(*keys).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    one = F.explode(F.array_repeat(F.when(F.col("__n") > 0, "left").otherwise("right"), F.abs("__n").cast("int")))
    return more.select(*keys, one.alias("side"))


def address(dims: Triple) -> Column:
    return (F.col("z") * dims[1] + F.col("y")) * dims[2] + F.col("x")


def coordinates(at: str, dims: Triple) -> dict[str, Column]:
    return {"z": F.expr(f"{at} div {dims[1] * dims[2]}"), "y": F.expr(f"({at} div {dims[2]}) % {dims[1]}"), "x": F.col(at) % dims[2]}


def level_for_memory(dz: Column, dy: Column, dx: Column, limit_gb: float, voxel_bytes: int = 2) -> Column:
    """The first level whose view fits: each level holds a quarter of the one before."""
    size = dz * dy * dx * voxel_bytes / F.lit(float(1 << 30))
    return F.greatest(F.lit(0), F.ceil(F.log2(size / limit_gb) / 2)).cast("long")


def placed_markers(markers: DataFrame, voxels: DataFrame, dims: Triple, level: int, least: float) -> DataFrame:
    """``markers`` (x, y, z at level 0) with lx, ly, lz at ``level`` (cut down) and whether a search can start there.

    It can where the place lies in ``dims`` of the level and its voxel has at least ``least``.
    """
    ratio = float(1 << level)
    at = markers.withColumns({"lz": F.floor("z").cast("long"), "ly": F.floor(F.col("y") / ratio).cast("long"), "lx": F.floor(F.col("x") / ratio).cast("long")})
    inside = F.lit(True)
    for a, n in zip("zyx", dims):
        inside &= F.col(f"l{a}").between(0, n - 1)
    held = voxels.where(F.col("v") >= least).select(*[F.col(a).alias(f"l{a}") for a in "zyx"], F.lit(True).alias("_bright"))
    return at.join(held, ["lz", "ly", "lx"], "left").withColumn("usable", inside & F.coalesce("_bright", F.lit(False))).drop("_bright")


def crops(points: DataFrame, by: str, margin: float, cell: float) -> DataFrame:
    """The box of the points of each ``by``, widened by ``margin``, and whether a box of a smaller ``by`` meets it.

    Boxes meet only where they share a grid cell of side ``cell``.
    """
    boxes = points.groupBy(by).agg(*[f(F.col(a)).alias(f"{a}{e}") for a in "zyx" for f, e in ((F.min, "min"), (F.max, "max"))])
    boxes = boxes.withColumns({f"{a}{e}": F.col(f"{a}{e}") + d for a in "zyx" for e, d in (("min", -margin), ("max", margin))})
    cells = boxes
    for a in "zyx":
        cells = cells.withColumn(f"_{a}", F.explode(F.sequence(F.floor(F.col(f"{a}min") / cell), F.floor(F.col(f"{a}max") / cell))))
    others = cells.select(F.col(by).alias("_by"), "_z", "_y", "_x", *[F.col(f"{a}{e}").alias(f"_{a}{e}") for a in "zyx" for e in ("min", "max")])
    meet = F.lit(True)
    for a in "zyx":
        meet &= (F.col(f"{a}min") < F.col(f"_{a}max")) & (F.col(f"_{a}min") < F.col(f"{a}max"))
    taken = cells.join(others, ["_z", "_y", "_x"]).where((F.col("_by") < F.col(by)) & meet).select(by).distinct().withColumn("_taken", F.lit(True))
    return boxes.join(taken, by, "left").withColumn("overlaps", F.coalesce("_taken", F.lit(False))).drop("_taken")
