"""Every registered query with an oracle against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from dendrovox import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = {name: sql for name, sql in registry.oracle_sql().items()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    keep = [tuple("" if r[i] is None else (round(float(r[i]), 4) + 0.0 if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i])) for i in order) for r in rows]
    return sorted(keep, key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, sf_dir, duck, name):
    frame = registry.queries()[name](spark, sf_dir)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    want, got = plain(result.fetchall(), names), plain(frame.collect(), frame.columns)
    assert len(want) == len(got)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-4)) for x, y in zip(a, b)), (a, b)


def test_paths_agree_with_each_other(spark, sf_dir):
    run = registry.queries()
    cost = {r["id"]: r["distance"] for r in run["dijkstra_cost"](spark, sf_dir).collect()}
    tree = {r["id"]: r["parent"] for r in run["marching_tree"](spark, sf_dir).collect()}
    outer = {r["id"] for r in run["sssp_boundary"](spark, sf_dir).collect()}
    assert set(cost) == set(tree) and outer == set(tree) - set(tree.values())
    assert all(p is None or cost[p] < cost[i] for i, p in tree.items())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
