"""Text formats of trees, markers and somas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SWC_FIELDS = (("node_id", "long"), ("node_type", "long"), ("x", "double"), ("y", "double"), ("z", "double"), ("radius", "double"), ("parent_id", "long"))


def parse_swc(lines: DataFrame) -> DataFrame:
    """Nodes of the lines in ``value``: seven fields split by blanks or commas, ``#`` for comments.

    Lines that do not hold seven numbers come back as rows with nulls in the fields that failed.
    """
    fields = F.split(F.trim("value"), r"[\s,]+")
    data = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    return data.select(*[F.get(fields, F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(SWC_FIELDS)])


def read_swc(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of all files below ``path``, with tree_id: the name of the file."""
    lines = spark.read.text(path).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("tree_id"))
    fields = F.split(F.trim("value"), r"[\s,]+")
    data = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    return data.select("tree_id", *[F.get(fields, F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(SWC_FIELDS)])


def swc_lines(tree: DataFrame) -> DataFrame:
    return tree.select(F.concat_ws(" ", *[F.col(name).cast("string") for name, _ in SWC_FIELDS]).alias("value"))


def write_swc(tree: DataFrame, path: str, notes: list[str] | None = None) -> None:
    """Lines in the order of node ids, over as many files as Spark makes of the order; ``notes`` come first, as comments."""
    lines = swc_lines(tree).withColumn("_at", F.element_at(F.split("value", " "), 1).cast("long"))
    if notes:
        head = tree.sparkSession.createDataFrame([(f"# {note}", k - len(notes)) for k, note in enumerate(notes)], "value string, k long")
        lowest = tree.agg(F.coalesce(F.min("node_id"), F.lit(0)).alias("low"))
        lines = lines.union(head.join(lowest).select("value", F.col("low") + F.col("k")))
    lines.orderBy("_at").select("value").write.mode("overwrite").text(path)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(tree_id, note) of the comment lines of all files below ``path``."""
    lines = spark.read.text(path).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("tree_id"))
    return lines.where(F.ltrim("value").startswith("#")).select("tree_id", F.trim(F.regexp_replace("value", r"^\s*#", "")).alias("note"))


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z and radius (0 if absent) of comma-separated lines; ``#`` for comments."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    fields = F.split("value", r"\s*,\s*")
    return lines.select(*[F.coalesce(F.get(fields, F.lit(i)).try_cast("double"), F.lit(0.0) if name == "radius" else F.lit(None).cast("double")).alias(name) for i, name in enumerate(("x", "y", "z", "radius"))])


def read_somas(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, mass of soma lines, cut to whole numbers."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    fields = F.split("value", r"\s*,\s*")
    return lines.select(*[F.floor(F.get(fields, F.lit(i)).try_cast("double")).cast("long").alias(name) for i, name in enumerate(("x", "y", "z", "mass"))])


def soma_marks(lines: DataFrame) -> DataFrame:
    """(node_id, x, y, z) of soma index lines: one field is a node, three are a place."""
    fields = F.split(F.trim("value"), r"[\s,]+")
    node = F.when(F.size(fields) == 1, F.get(fields, F.lit(0)).try_cast("long")).alias("node_id")
    place = [F.when(F.size(fields) == 3, F.get(fields, F.lit(i)).try_cast("double")).alias(a) for i, a in enumerate("xyz")]
    return lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#")).select(node, *place)
