"""Queries of the array, graph and tree operators on tables derived from the driver's data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dendrovox.queries import decisions, images, partition, traces, trees, volumes

ALL = volumes.QUERIES | trees.QUERIES | images.QUERIES | partition.QUERIES | traces.QUERIES | decisions.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
