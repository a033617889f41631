"""Volumes, trees, points, planes and polylines derived from the relational tables, in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrovox.plans.durable import unsent

YDIM, XDIM = 32, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Line items for each partition of a volume, and how many leave the number of partitions to Spark.
PART_ROWS, FEW_ROWS = 500_000, 8_000_000


def parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions of a volume, so that none grows with it; none for a small one.

    Spark would join partitions by the bytes of their compressed shuffle, and voxels take up to twenty times those in memory.
    """
    rows = table(spark, sf_dir, "lineitem").count()
    return -(-rows // PART_ROWS) if rows > FEW_ROWS else None


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z, y, x, v: how many line items fall on each voxel. Each 32 suppliers make seven more planes, so the volume grows with the data."""
    at = {"z": (F.col("l_linenumber") - 1 + 7 * F.expr("l_suppkey div 32")).cast("long"), "y": F.col("l_suppkey") % YDIM, "x": F.col("l_partkey") % XDIM}
    places = table(spark, sf_dir, "lineitem").select(*[c.alias(a) for a, c in at.items()])
    if n := parts(spark, sf_dir):
        places = places.repartition(n, *at)
    return places.groupBy(*at).agg(F.count(F.lit(1)).alias("v"))


def dims(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    """Planes, rows and columns of the volume."""
    last = table(spark, sf_dir, "lineitem").agg(F.max(F.col("l_linenumber") - 1 + 7 * F.expr("l_suppkey div 32")).alias("z")).first()["z"]
    return int(last if last is not None else -1) + 1, YDIM, XDIM


VOXELS = "voxels AS (SELECT CAST(l_linenumber - 1 + 7 * (l_suppkey // 32) AS BIGINT) AS z, l_suppkey % 32 AS y, l_partkey % 32 AS x, count(*) AS v FROM lineitem GROUP BY 1, 2, 3)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One neuron tree over the customers: node n hangs below about n / 2."""
    node = F.col("c_custkey") + 1
    parent = F.when(node == 1, F.lit(-1)).otherwise(F.greatest(F.lit(1), F.expr("(c_custkey + 1 - c_nationkey % 2) div 2")))
    return unsent(table(spark, sf_dir, "customer")).select(
        node.alias("node_id"), (F.col("c_nationkey") % 5).cast("long").alias("node_type"),
        F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"), (F.col("c_custkey") % 50).cast("double").alias("z"),
        (1 + F.col("c_nationkey") % 7).cast("double").alias("radius"), parent.cast("long").alias("parent_id"),
    )


TREE = """tree AS (SELECT c_custkey + 1 AS node_id, CAST(c_nationkey % 5 AS BIGINT) AS node_type, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y,
  CAST(c_custkey % 50 AS DOUBLE) AS z, CAST(1 + c_nationkey % 7 AS DOUBLE) AS radius,
  CAST(CASE WHEN c_custkey = 0 THEN -1 ELSE greatest(1, (c_custkey + 1 - c_nationkey % 2) // 2) END AS BIGINT) AS parent_id FROM customer)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, cloud, x, y, z: three components of each vector, scaled by 100."""
    at = [(F.element_at("embedding", i).cast("double") * 100).alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("cloud"), *at)


POINTS = "points AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS cloud, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z FROM embeddings)"


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z (day), i (event), v: events as the pixels of a plane for each day."""
    return table(spark, sf_dir, "events").select(F.datediff(F.to_date("ts"), F.lit("2020-01-01")).cast("long").alias("z"), F.col("event_id").alias("i"), F.floor("value").cast("long").alias("v"))


PLANES = "planes AS (SELECT CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS BIGINT) AS z, event_id AS i, CAST(floor(value) AS BIGINT) AS v FROM events)"


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, seq, x, y, z, radius: the orders of each customer in time."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("line"), F.struct("o_orderdate", "o_orderkey").alias("seq"),
        (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_orderkey") % 97).cast("double").alias("y"), (F.col("o_custkey") % 89).cast("double").alias("z"), (1 + F.col("o_orderkey") % 5).cast("double").alias("radius"),
    )


POLYLINES = "polylines AS (SELECT o_custkey AS line, o_orderdate AS d, o_orderkey AS k, o_totalprice / 1000 AS x, CAST(o_orderkey % 97 AS DOUBLE) AS y, CAST(o_custkey % 89 AS DOUBLE) AS z, CAST(1 + o_orderkey % 5 AS DOUBLE) AS radius FROM orders)"
