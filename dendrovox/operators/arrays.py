"""Array math over voxels and planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMITS = {"u8": (0, 255), "s8": (-128, 127), "u16": (0, 65535), "s16": (-32768, 32767), "u32": (0, 4294967295), "s32": (-2147483648, 2147483647)}


def wrap(v: Column, kind: str) -> Column:
    """Narrowing cast: keeps the low bits."""
    low, high = LIMITS[kind]
    return F.pmod(v - low, F.lit(high - low + 1)) + low


def saturate(v: Column, kind: str) -> Column:
    low, high = LIMITS[kind]
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def normalize(df: DataFrame, kind: str, v: str = "v") -> DataFrame:
    """Values stretched from [min, max] to [0, largest of ``kind``] and cut to whole numbers."""
    high = LIMITS[kind][1]
    ends = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    scaled = (F.col(v) - F.col("_lo")) * (F.lit(float(high)) / (F.col("_hi") - F.col("_lo") + F.lit(1e-12)))
    return df.join(F.broadcast(ends)).withColumn(v, F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(float(high)))).cast("long")).drop("_lo", "_hi")


def top_percentile(df: DataFrame, q: float, by: list[str] | None = None, v: str = "v", out: str = "threshold") -> DataFrame:
    """The value at rank (1 - q) n, to the nearest and ties down, of each group ``by``.

    Values are counted first, so the running sum sees each distinct value once and no group of
    voxels meets in one task.
    """
    by = by or []
    counts = df.groupBy(*by, v).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    upto = group.orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(group)})
    index = F.least(F.col("_all") - 1, F.ceil(F.lit(1 - q) * F.col("_all") - 0.5))
    return counts.where((F.col("_upto") > index) & (F.col("_upto") - F.col("_n") <= index)).select(*by, F.col(v).alias(out))


def threshold(v: Column, t: Column, positive: int = 1, negative: int = 0, keep: bool = False) -> Column:
    return F.when(v >= t, v if keep else F.lit(positive)).otherwise(F.lit(negative))


def pyramid(df: DataFrame, how: str = "max") -> DataFrame:
    """Half the resolution in y and x: max, sum or avg of 2 x 2 voxels."""
    parents = [F.col("z"), F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")]
    return df.groupBy(*parents).agg(getattr(F, how)("v").alias("v"))


def _reflected(at: Column, size: int) -> Column:
    return F.when(at < 0, -at).when(at >= size, 2 * (size - 1) - at).otherwise(at)


def pyramid_gauss(df: DataFrame, ydim: int, xdim: int) -> DataFrame:
    """Half the resolution by the 5 x 5 kernel [1 4 6 4 1] / 16, borders reflected, rounded.

    Each voxel is sent to the at most nine parents whose kernel covers it, with its weight there.
    """
    kernel = (1, 4, 6, 4, 1)
    weights = F.create_map(*[F.lit(x) for pair in zip(range(-2, 3), kernel) for x in pair])

    def spread(axis: str, size: int) -> Column:
        """Structs (parent, weight): all taps of all parents that read this place."""
        parents = F.sequence(F.greatest(F.lit(0), F.expr(f"({axis} - 2) div 2")), F.least(F.lit((size // 2) - 1), F.expr(f"({axis} + 3) div 2")))
        taps = F.transform(parents, lambda p: F.struct(p.alias("p"), F.aggregate(
            F.array(*[F.lit(d) for d in range(-2, 3)]), F.lit(0),
            lambda acc, d: acc + F.when(_reflected(2 * p + d, size) == F.col(axis), F.element_at(weights, d)).otherwise(0)).alias("w")))
        return F.filter(taps, lambda t: t["w"] > 0)

    sent = df.withColumn("_y", F.explode(spread("y", ydim))).withColumn("_x", F.explode(spread("x", xdim)))
    total = F.sum(F.col("v") * F.col("_y.w") * F.col("_x.w"))
    return sent.groupBy("z", F.col("_y.p").cast("long").alias("y"), F.col("_x.p").cast("long").alias("x")).agg(F.expr("1").alias("_"), total.alias("s")).select("z", "y", "x", F.expr("(s + 128) div 256").alias("v"))


def convolve(df: DataFrame, axis: str, kernel: list[float], size: int) -> DataFrame:
    """Convolution along one axis with zeros outside; rows of the other axes stay as they are."""
    half = len(kernel) // 2
    taps = F.array(*[F.struct(F.lit(i - half).alias("d"), F.lit(float(w)).alias("w")) for i, w in enumerate(kernel)])
    others = [a for a in ("z", "y", "x") if a != axis]
    sent = df.withColumn("_t", F.explode(taps)).withColumn(axis, F.col(axis) - F.col("_t.d")).where(F.col(axis).between(0, size - 1))
    return sent.groupBy(*others, axis).agg(F.sum(F.col("v") * F.col("_t.w")).alias("v"))


def gaussian_kernel(k: int, sigma: float) -> list[float]:
    import math

    raw = [math.exp(-((i - k // 2) ** 2) / (2 * sigma * sigma)) for i in range(k)]
    return [w / sum(raw) for w in raw]


def plane_cdf(df: DataFrame, by: str = "z", v: str = "v") -> DataFrame:
    """n, and the share of the plane up to each value."""
    counts = df.groupBy(by, v).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(by)
    upto = whole.orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("cdf", F.sum("n").over(upto) / F.sum("n").over(whole))


def match_histograms(df: DataFrame, history: int, decay: float = 1.0, by: str = "z", v: str = "v") -> DataFrame:
    """Each plane's values mapped to those of the planes before it: (by, v, matched).

    A value goes to the least value whose share in the ``history`` planes before (weighted by
    ``decay`` per step back) reaches its own share, or one step up where these planes hold that next
    value too. The first ``history`` planes stay.
    """
    cdf = plane_cdf(df, by, v)
    order = cdf.select(by).distinct().withColumn("_at", F.row_number().over(Window.orderBy(by)))
    placed = cdf.join(order, by)
    back = F.explode(F.sequence(F.lit(1), F.lit(history))).alias("_back")
    past = placed.select("_at", v, "n", back).select((F.col("_at") + F.col("_back")).alias("_at"), F.col(v).alias("_pv"), (F.col("n") * F.pow(F.lit(float(decay)), F.col("_back") - 1)).alias("_w"))
    past = past.groupBy("_at", "_pv").agg(F.sum("_w").alias("_w"))
    whole = Window.partitionBy("_at")
    upto = whole.orderBy("_pv").rowsBetween(Window.unboundedPreceding, 0)
    past = past.withColumn("_share", F.sum("_w").over(upto) / F.sum("_w").over(whole))
    past = past.withColumn("_to", F.when(F.lead("_pv").over(whole.orderBy("_pv")) == F.col("_pv") + 1, F.col("_pv") + 1).otherwise(F.col("_pv")))
    # both CDFs of a plane in one order, past values behind equal shares; the next past value answers
    none = F.lit(None)
    asked = placed.select("_at", by, v, (F.col("cdf") - 1e-12).alias("_s"), F.lit(0).alias("_side"), none.cast(past.schema["_pv"].dataType).alias("_pv"), none.cast(past.schema["_to"].dataType).alias("_to"))
    given = past.select("_at", none.cast(placed.schema[by].dataType).alias(by), none.cast(placed.schema[v].dataType).alias(v), F.col("_share").alias("_s"), F.lit(1).alias("_side"), "_pv", "_to")
    after = whole.orderBy("_s", "_side", "_pv").rowsBetween(0, Window.unboundedFollowing)
    merged = asked.unionByName(given).withColumn("_m", F.first("_to", ignorenulls=True).over(after)).where("_side = 0")
    return merged.select(by, v, F.when((F.col("_at") > history) & F.col("_m").isNotNull(), F.col("_m")).otherwise(F.col(v)).alias("matched"))
