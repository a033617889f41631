"""Half-open boxes as structs (zmin, zmax, ymin, ymax, xmin, xmax); a missing bound makes one empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDS = tuple(f"{a}{e}" for a in "zyx" for e in ("min", "max"))
TYPE = "struct<" + ",".join(f"{b}:long" for b in BOUNDS) + ">"


def box(*bounds: Column) -> Column:
    return F.struct(*[b.cast("long").alias(n) for b, n in zip(bounds, BOUNDS, strict=True)])


def is_empty(b: Column) -> Column:
    short = [F.coalesce(b[f"{a}min"] >= b[f"{a}max"], F.lit(True)) for a in "zyx"]
    return b.isNull() | reduce(lambda x, y: x | y, short)


def volume(b: Column) -> Column:
    sides = [b[f"{a}max"] - b[f"{a}min"] for a in "zyx"]
    return F.when(is_empty(b), F.lit(0)).otherwise(reduce(lambda x, y: x * y, sides)).cast("long")


def enclose(a: Column, b: Column) -> Column:
    """The least box around both; an empty one adds nothing."""
    both = box(*[f(a[n], b[n]) for c in "zyx" for f, n in ((F.least, f"{c}min"), (F.greatest, f"{c}max"))])
    return F.when(is_empty(a), b).when(is_empty(b), a).otherwise(both)


def intersect(a: Column, b: Column) -> Column:
    """What both share; null if nothing."""
    both = box(*[f(a[n], b[n]) for c in "zyx" for f, n in ((F.greatest, f"{c}min"), (F.least, f"{c}max"))])
    return F.when(~is_empty(a) & ~is_empty(b) & ~is_empty(both), both)


def holds(b: Column, z: Column, y: Column, x: Column) -> Column:
    return reduce(lambda p, q: p & q, [(v >= b[f"{a}min"]) & (v < b[f"{a}max"]) for a, v in zip("zyx", (z, y, x))])


def distance(b: Column, z: Column, y: Column, x: Column) -> Column:
    """From a place to the nearest place in the box."""
    off = [F.greatest(b[f"{a}min"] - v, v - (b[f"{a}max"] - 1), F.lit(0)) for a, v in zip("zyx", (z, y, x))]
    return F.sqrt(reduce(lambda p, q: p + q, [o * o for o in off]).cast("double"))
