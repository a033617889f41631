"""Dense ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: 0-based gapless rank in each ``group``, ordered by (bucket, *order).

    A group never meets in one task: rows are numbered inside (group, bucket) and shifted by the
    count of all lower buckets. ``bucket`` must spread the rows of a hot group; the window over
    bucket counts sees at most one row per bucket. ``group`` columns must not be null. All other
    columns of ``df`` come back as they are, whatever their names; one named ``out`` is replaced.
    """
    fresh = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0))
    at, n, start, row = (f"{fresh}{x}" for x in ("bucket", "n", "start", "row"))
    keyed = df.withColumn(at, bucket)
    sizes = keyed.groupBy(*group, at).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, at, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    local = keyed.withColumn(row, F.row_number().over(Window.partitionBy(*group, at).orderBy(*order)))
    return local.join(starts, [*group, at]).withColumn(out, (F.col(start) + F.col(row) - 1).cast("long")).drop(at, row, start)
