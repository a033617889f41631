"""Cutting lineage through storage that every executor can reach."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or given to ``setCheckpointDir``; without one this raises.

    Only a folder that driver and executors share will do, so none is made up. A local session, whose
    only machine is the driver's, takes one in its folder for temporary files.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root and context.master.startswith("local"):
        root = f"file://{os.path.join(tempfile.gettempdir(), 'spark-checkpoint')}"
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared root."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows up to which a table may be sent whole to the tasks that join it: some MB.
SENT_ROWS = 50_000


def unsent(df: DataFrame) -> DataFrame:
    """``df``, joined by shuffles: what is planned by the size of compressed files would be sent through the driver at many times that size."""
    return df.hint("merge")


def materialize(df: DataFrame) -> DataFrame:
    """``df`` as a table written below the shared root: its lineage is cut and its size known.

    A checkpoint would keep the size that was estimated for it, which for a join is the product of both
    sides': in rounds of joins that estimate grows to millions of digits and planning takes longer than
    the work. A table has the size it has, so small ones are sent to the tasks that join them; those of
    more than ``SENT_ROWS`` rows are not, however well their files are compressed.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    return unsent(written) if written.count() > SENT_ROWS else written
