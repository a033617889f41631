"""Clustering by subvector dictionaries against plain rounds over whole vectors."""

import hashlib
import math

import numpy as np
import pytest

from dendrovox.llm import subvectors


def plain(rows, clusters=16, rounds=3, dims=64):
    """Whole numbers, centroids and sums as the contract words them, without numpy."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)[:clusters]
    centroids = [v for _, _, v in start]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest(v):
        return min((apart(v, c), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, members in groups.items():
            centroids[k] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, k, d in found:
        inertia[k] = inertia.get(k, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), sha[k]) for i, k, d in found), key=str)


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("seed, n, chunk_rows, block", [(1, 300, 64, 2), (2, 300, 16_384, 5), (3, 7, 3, 64)])
def test_clusters_match_plain_rounds(spark, seed, n, chunk_rows, block):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-40, 40, 64) / 64 + rng.choice([0, 0.001, 3.5])).tolist()) for i in range(n)]
    rows += [(7, rows[1][1]), (7, rows[1][1]), (None, rows[2][1]), (-5, rows[0][1]), (8, None), (9, [1.0] * 63), (10, [1.0] * 63 + [None]), (11, [1.0] * 63 + [math.inf]), (12, [math.nan] * 64)]
    got = sorted((tuple(r) for r in subvectors.cluster(frame_of(spark, rows), chunk_rows=chunk_rows, block=block).collect()), key=str)
    assert got == plain(rows)


def test_codes_lose_nothing():
    rng = np.random.default_rng(9)
    whole = rng.integers(-(1 << 27), 1 << 27, (500, 7)).astype(np.int32)
    whole[::3] = whole[0]
    words, codes = subvectors.encode(whole, 3)
    chunk = subvectors.Chunk(words, codes, 7, 3)
    assert (chunk.decoded() == whole).all() and len(chunk.words[0]) <= 334
    near, sums = chunk.sums(np.arange(500) % 4, 4)
    assert near.tolist() == [125] * 4 and (sums == [whole[k::4].astype(np.int64).sum(0) for k in range(4)]).all()


def test_ties_go_to_the_smaller_centroid_and_empty_ones_stay(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]
    got = sorted((tuple(r) for r in subvectors.cluster(frame_of(spark, rows)).collect()), key=str)
    assert got == plain(rows) and {k for _, k, *_ in got} <= {0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10}


def test_vectors_beyond_the_range_and_no_vectors(spark):
    far = (3, [1e9] + [0.0] * 63)
    rows = [(i, [i / 8] * 64) for i in (0, 1, 2)]
    got = {r["vec_id"]: tuple(r) for r in subvectors.cluster(frame_of(spark, [*rows, far])).collect()}
    assert got[3] == (3, None, None, None, None, None) and sorted(v for k, v in got.items() if k != 3) == plain(rows)
    assert subvectors.cluster(frame_of(spark, []).where("false")).collect() == []
    assert [tuple(r) for r in subvectors.cluster(frame_of(spark, [(None, [0.0] * 64)])).collect()] == [(None,) * 6]


def test_other_columns_do_no_harm(spark):
    from tests.llm.test_edges import NAMES
    from pyspark.sql import functions as F

    rows = [(i, [i / 8] * 64) for i in range(5)]
    frame = frame_of(spark, rows).select("*", *[F.lit(77).alias(c) for c in [*NAMES, "ids", "id", "v", "words", "codes", "cluster", "distance", "inertia", "sum"] if c not in ("vec_id", "v", "id")])
    assert sorted((tuple(r) for r in subvectors.cluster(frame).collect()), key=str) == plain(rows)
