"""The pyramid catalog: dims and chunks of each channel and level, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOG = "c int, level int, zdim int, ydim int, xdim int, chunk_z int, chunk_y int, chunk_x int, dtype string, format string"


def with_ratios(catalog: DataFrame) -> DataFrame:
    """Ratios of each level to level 0 of its channel."""
    base = catalog.where("level = 0").select("c", *[F.col(f"{a}dim").alias(f"_{a}") for a in "zyx"])
    return catalog.join(base, "c", "left").withColumns({f"{a}_ratio": F.expr(f"_{a} div {a}dim") for a in "zyx"}).drop("_z", "_y", "_x")


def violations(catalog: DataFrame) -> DataFrame:
    """(c, level, rule) of every broken rule; no rows: the catalog is sound."""
    rated = with_ratios(catalog)
    power = F.expr("cast(shiftleft(1, level) as bigint)")
    rules = {
        "no level 0": F.col("z_ratio").isNull(),
        "xy ratio is not 2^level": (F.col("y_ratio") != power) | (F.col("x_ratio") != power),
        "z ratio below 1": F.col("z_ratio") < 1,
        "chunk larger than the level": (F.col("chunk_z") > F.col("zdim")) | (F.col("chunk_y") > F.col("ydim")) | (F.col("chunk_x") > F.col("xdim")),
    }
    own = rated.select("c", "level", F.explode(F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda r: r.isNotNull())).alias("rule"))
    level = Window.partitionBy("level")
    apart = catalog.withColumns({f"_{a}": F.min(f"{a}dim").over(level) != F.max(f"{a}dim").over(level) for a in "zyx"})
    return own.union(apart.where("_z or _y or _x").select("c", "level", F.lit("channels differ in dims")))


def deepest_level(y: Column, x: Column) -> Column:
    """The last level whose ratio is at most the smaller of the two dims."""
    return F.floor(F.log2(F.least(y, x).cast("double"))).cast("long")


def expected_chunks(catalog: DataFrame) -> DataFrame:
    """(c, level, cz, cy, cx) of every chunk that a complete level has."""
    grid = catalog.select("c", "level", "zdim", "ydim", "xdim", "chunk_z", "chunk_y", "chunk_x")
    for a in "zyx":
        grid = grid.withColumn(f"c{a}", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({a}dim - 1) div chunk_{a}"))))
    return grid.select("c", "level", "cz", "cy", "cx")


def missing_chunks(catalog: DataFrame, present: DataFrame) -> DataFrame:
    return expected_chunks(catalog).join(present, ["c", "level", "cz", "cy", "cx"], "left_anti")


def completeness(catalog: DataFrame, present: DataFrame) -> DataFrame:
    """Chunks expected and present of each level, and whether it is complete."""
    expected = expected_chunks(catalog).join(present.distinct().withColumn("_here", F.lit(1)), ["c", "level", "cz", "cy", "cx"], "left")
    counts = expected.groupBy("c", "level").agg(F.count(F.lit(1)).alias("expected"), F.coalesce(F.sum("_here"), F.lit(0)).alias("present"))
    return counts.withColumn("complete", F.col("expected") == F.col("present"))


def padded(number: Column, width: int) -> Column:
    """A whole number with zeros in front, at least ``width`` wide; longer ones are whole."""
    return F.when(number.isNotNull(), F.format_string(f"%0{width}d", number))


def chunk_path(level: Column, z: Column, y: Column, x: Column, sizes: tuple[int, int, int]) -> Column:
    """Folder of the chunk that holds a place: level, then one range for each axis."""
    parts = [F.concat(F.lit("pyr_level_"), padded(level, 2))]
    for axis, at, n in zip("zyx", (z, y, x), sizes):
        low = F.floor(at / n) * n
        parts.append(F.concat(F.lit(axis), padded(low, 4), F.lit("_"), padded(low + n, 6)))
    return F.concat_ws("/", *parts)


def parsed_path(path: Column) -> dict[str, Column]:
    """Level and first z, y and x that a chunk's path states."""
    found = {"level": F.regexp_extract(path, r"pyr_level_(\d{2,})", 1).cast("long")}
    return found | {f"{a}0": F.regexp_extract(path, rf"/{a}(\d{{4,}})_\d+", 1).try_cast("long") for a in "zyx"}


def save(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).json(path)
