"""The corpus queries that SQL can express, against DuckDB on the smallest tables."""

import pytest

from dendrovox.llm import registry
from tests.test_registry import TABLES, plain


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_corpus_query_matches_its_oracle(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    frame = registry.queries()[name](spark, sf_dir)
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert plain(frame.collect(), frame.columns) == plain(result.fetchall(), names)


def test_neighbours_of_the_given_table_are_found(spark, sf_dir):
    """Recall of the registered search against the exact ranks."""
    import numpy as np

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = {}
    for r in registry.queries()["op8_prefix_forest_neighbours"](spark, sf_dir).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, got in found.items():
        far = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        hits += len(got & set(ids[np.lexsort((ids, far))[:10]].tolist()))
    assert sorted(found) == sorted(i for i in ids.tolist() if i % 100 == 0) and hits >= 0.9 * 10 * len(found)
