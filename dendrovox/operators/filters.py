"""Intensity adjustment and line filters, as neighbour sums and closed forms on columns."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrovox.operators.arrays import convolve
from dendrovox.operators.views import Triple


def to_binary_gray(*channels: Column) -> Column:
    """255 where any channel is above 0."""
    return F.when(F.greatest(*[F.coalesce(c, F.lit(0)) for c in channels]) > 0, 255).otherwise(0)


def smoothed(voxels: DataFrame, kernel: list[float], dims: Triple, axes: str = "zyx") -> DataFrame:
    """Convolved along ``axes`` one after the other, with zeros outside."""
    for axis, n in zip("zyx", dims):
        if axis in axes:
            voxels = convolve(voxels, axis, kernel, n)
    return voxels


def adjusted(voxels: DataFrame, kernel: list[float], dims: Triple, c1: float, c2: float) -> DataFrame:
    """Non-linear adjustment of values in [0, 1] around their smoothed surroundings S.

    B = c1 S / (1 - S) + c2; out = (v / S) (S^B + B S^(B - 1) (v - S)), cut to [0, 1]; 0 where S is 0.
    """
    near = smoothed(voxels.select("z", "y", "x", "v"), kernel, dims).withColumnRenamed("v", "_s")
    s, v = F.least(F.col("_s"), F.lit(1 - 1e-9)), F.col("v")
    b = c1 * s / (1 - s) + c2
    out = (v / s) * (F.pow(s, b) + b * F.pow(s, b - 1) * (v - s))
    return voxels.join(near, ["z", "y", "x"]).withColumn("v", F.when(F.col("_s") > 0, F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)).drop("_s")


def hessian(voxels: DataFrame, axes: str = "zyx", parts: int | None = None, chunk: Triple = (32, 64, 64)) -> DataFrame:
    """(z, y, x, h_ab...): second differences at every voxel that is there; absent neighbours count 0.

    Each voxel is sent to the ``chunk`` that holds it and, at a border, to those beside it; differences are
    taken there, so no voxel becomes a row for each of its neighbours. ``parts``: partitions, else Spark's.
    """
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    taps: dict[tuple[int, ...], dict[str, float]] = {}

    def tap(step: dict[str, int], name: str, w: float) -> None:
        key = tuple(step.get(a, 0) for a in "zyx")
        held = taps.setdefault(key, {})
        held[name] = held.get(name, 0.0) + w

    for a, b in pairs:
        if a == b:
            for d, w in ((-1, 1.0), (0, -2.0), (1, 1.0)):
                tap({a: d}, a + b, w)
        else:
            for d, e in product((-1, 1), repeat=2):
                tap({a: d, b: e}, a + b, d * e / 4)
    names, keys = [a + b for a, b in pairs], [f"k{a}" for a in "zyx"]
    sent = voxels.dropna(subset=["z", "y", "x"]).select(*[F.col(a).cast("long").alias(a) for a in "zyx"], F.col("v").cast("double").alias("v"))
    for a, n in zip("zyx", chunk):
        near = F.array_distinct(F.array(*[F.floor((F.col(a) + d) / n) for d in (-1, 0, 1)]))
        sent = sent.withColumn(f"k{a}", F.explode(near) if a in axes else F.floor(F.col(a) / n))
    if parts:
        sent = sent.repartition(parts, *keys)

    def differences(part: pa.Table) -> pa.Table:
        at = np.stack([part.column(a).to_numpy() for a in "zyx"], 1)
        here = np.array([part.column(k)[0].as_py() for k in keys])
        own = (at // np.array(chunk) == here).all(1)
        first = at.min(0) - 1
        size = at.max(0) - first + 2
        image, seen, mine = np.zeros(size), np.zeros(size, bool), np.zeros(size, bool)
        known = part.column("v").is_valid().to_numpy()
        places = tuple((at - first).T)
        np.add.at(image, tuple(c[known] for c in places), part.column("v").drop_null().to_numpy())
        seen[tuple(c[known] for c in places)] = True
        mine[tuple(c[own] for c in places)] = True
        z, y, x = np.nonzero(mine)
        sums, met = {n: np.zeros(len(z)) for n in names}, np.zeros(len(z), bool)
        for (dz, dy, dx), held in taps.items():
            v = image[z + dz, y + dy, x + dx]
            met |= seen[z + dz, y + dy, x + dx]
            for n in names:
                sums[n] += v * held.get(n, 0.0)
        # Where nothing around is known, no difference is.
        return pa.table([pa.array(c + f) for c, f in zip((z, y, x), first)] + [pa.array(sums[n], mask=~met) for n in names], names=[*"zyx", *[f"h_{n}" for n in names]])

    found = sent.groupBy(*keys).applyInArrow(differences, ", ".join([f"{a} long" for a in "zyx"] + [f"h_{n} double" for n in names]))
    return found.select(*[F.col(a).cast(voxels.schema[a].dataType).alias(a) for a in "zyx"], *[f"h_{n}" for n in names])


def vesselness_2d(planes: DataFrame, beta: float = 0.5, c: float = 1.0, parts: int | None = None) -> DataFrame:
    """(z, y, x, v): how much a bright line runs through a voxel of its plane; 0 unless the larger eigenvalue is negative."""
    h = hessian(planes, "yx", parts)
    half, diff = (F.col("h_yy") + F.col("h_xx")) / 2, (F.col("h_yy") - F.col("h_xx")) / 2
    root = F.sqrt(diff * diff + F.col("h_yx") * F.col("h_yx"))
    one, two = half + root, half - root
    h = h.withColumns({"_1": F.when(F.abs(one) <= F.abs(two), one).otherwise(two), "_2": F.when(F.abs(one) <= F.abs(two), two).otherwise(one)})
    ratio, size = F.col("_1") / F.col("_2"), F.col("_1") * F.col("_1") + F.col("_2") * F.col("_2")
    line = F.exp(-(ratio * ratio) / (2 * beta * beta)) * (1 - F.exp(-size / (2 * c * c)))
    return h.select("z", "y", "x", F.when(F.col("_2") < 0, line).otherwise(0.0).alias("v"))


def eigenvalues(h: DataFrame) -> DataFrame:
    """``h`` with e1 >= e2 >= e3 of the symmetric matrices in its h_ columns, by the trigonometric closed form."""
    zz, yy, xx, zy, zx, yx = (F.col(f"h_{n}") for n in ("zz", "yy", "xx", "zy", "zx", "yx"))
    h = h.withColumn("_q", (zz + yy + xx) / 3)
    q = F.col("_q")
    h = h.withColumn("_p", F.sqrt(((zz - q) * (zz - q) + (yy - q) * (yy - q) + (xx - q) * (xx - q) + 2 * (zy * zy + zx * zx + yx * yx)) / 6))
    a, b, d = zz - q, yy - q, xx - q
    det = a * (b * d - yx * yx) - zy * (zy * d - yx * zx) + zx * (zy * yx - b * zx)
    r = F.try_divide(det, 2 * F.col("_p") * F.col("_p") * F.col("_p"))
    h = h.withColumn("_f", F.acos(F.least(F.greatest(F.coalesce(r, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))) / 3)
    h = h.withColumns({"e1": q + 2 * F.col("_p") * F.cos("_f"), "e3": q + 2 * F.col("_p") * F.cos(F.col("_f") + 2 * math.pi / 3)})
    return h.withColumn("e2", 3 * q - F.col("e1") - F.col("e3")).drop("_q", "_p", "_f")


#: Share by which eigenvalues must differ to count as different.
TIE = 1e-6


def vesselness_3d(voxels: DataFrame, parts: int | None = None) -> DataFrame:
    """(z, y, x, v): lines of a volume. With |l1| <= |l2| <= |l3| it is 0 unless l2 and l3 are negative, else

    exp(-l1^2 / |l2 l3|) (1 - exp(-(l1^2 + l2^2 + l3^2) / 2)) (1 - exp(-(l2 / l3)^2)).

    Of l1 and l2 that are equal but for their sign, to a share of ``TIE``, the positive one is l2: no
    line. An l2 of less than that share of l3 is 0. So no rounding of the eigenvalues decides.
    """
    # The two lowest eigenvalues are l2 and l3 wherever there is a line.
    e = eigenvalues(hessian(voxels, parts=parts))
    l1, l2, l3 = F.col("e1"), F.col("e2"), F.col("e3")
    size = l1 * l1 + l2 * l2 + l3 * l3
    line = F.exp(-(l1 * l1) / F.abs(l2 * l3)) * (1 - F.exp(-size / 2)) * (1 - F.exp(-((l2 / l3) * (l2 / l3))))
    return e.select("z", "y", "x", F.when((l2 < TIE * l3) & (l1 < -l2 * (1 - TIE)), line).otherwise(0.0).alias("v"))


def brightened(voxels: DataFrame, line: DataFrame) -> DataFrame:
    """Intensities times exp of the line filter's answer."""
    return voxels.join(line.withColumnRenamed("v", "_line"), ["z", "y", "x"], "left").withColumn("v", F.col("v") * F.exp(F.coalesce("_line", F.lit(0.0)))).drop("_line")


def widest(answers: list[DataFrame]) -> DataFrame:
    """The largest answer of several scales at each voxel."""
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out.groupBy("z", "y", "x").agg(F.max("v").alias("v"))
