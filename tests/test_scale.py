"""Steps whose work must not grow faster than their tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dendrovox.operators import chunks, filters, similarity, trees, views
from dendrovox.operators.views import Block
from dendrovox.plans import catalog
from dendrovox.sources import derived

TREE = "node_id long, node_type long, x double, y double, z double, radius double, parent_id long"


def test_a_wide_cell_is_no_reach_of_all_edges(spark, monkeypatch):
    rng = random.Random(3)
    spots = [[rng.uniform(0, 40) for _ in range(3)] for _ in range(60)]
    tree = spark.createDataFrame([(i, 0, *p, 1.0, i - 1) for i, p in enumerate(spots)], TREE)
    asked = [(i, i % 2, *[rng.uniform(-5, 45) for _ in range(3)]) for i in range(40)] + [(99, 0, 70.0, 0.0, 0.0)]
    points = spark.createDataFrame(asked, "node_id long, k int, x double, y double, z double")
    monkeypatch.setattr(similarity, "FEW", 10)
    reaches, met = [], similarity._met

    def watched(asked, cut, reach):
        reaches.append(reach)
        out = met(asked, cut, reach)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
        return out

    monkeypatch.setattr(similarity, "_met", watched)
    found = {(r["node_id"], r["k"]): r["distance"] for r in similarity.point_distances(points, tree, 1e6).collect()}
    assert reaches[0] < 20

    def far(p, a, b):
        d = [y - x for x, y in zip(a, b)]
        t = min(max(sum(x * (q - y) for x, q, y in zip(d, p, a)) / sum(x * x for x in d), 0.0), 1.0)
        return sum((q - y - t * x) ** 2 for q, y, x in zip(p, a, d)) ** 0.5

    assert len(found) == 41
    for i, k, *p in asked:
        assert found[i, k] == pytest.approx(min(far(p, a, b) for a, b in zip(spots, spots[1:])))


def test_few_nodes_in_one_cube_are_measured_without_a_search(spark, monkeypatch):
    rng = random.Random(4)
    nodes = [(i, rng.uniform(90, 90.5), 3.0, 1.0) for i in range(30)] + [(30, 95.0, 3.0, 1.0), (31, 97.0, 3.0, 1.0)]
    asked = [(i, rng.uniform(-100, 100), rng.uniform(0, 9), 2.0) for i in range(50)] + [(50, 96.0, 3.0, 1.0), (51, None, 0.0, 0.0), (52, float("nan"), 0.0, 0.0)]
    tree = spark.createDataFrame(nodes, "node_id long, x double, y double, z double")
    targets = spark.createDataFrame(asked, "target_id long, x double, y double, z double")
    written, keep = [], trees.materialize
    monkeypatch.setattr(trees, "materialize", lambda df: written.append(1) or keep(df))
    found = {r["target_id"]: (r["node_id"], r["distance"]) for r in trees.nearest_node(tree, targets, 0.01).collect()}
    # A search in cubes of 0.01 would go through more than ten rounds of two tables each.
    assert len(written) <= 3
    assert len(found) == 53 and found[50][0] == 30 and found[51] == found[52] == (None, None)
    for i, *p in asked[:50]:
        far, least = min((sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5, n) for n, *q in nodes)
        assert found[i] == (least, pytest.approx(far))


def test_sides_of_volumes_are_counted_at_once(spark):
    kind = "z long, y long, x long, v long"
    a = spark.createDataFrame([(0, 0, 0, 1)] * 3 + [(0, 0, 1, None), (1, 0, 0, 5), (None, 0, 0, 2)], kind)
    b = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, None), (1, 0, 0, 6), (None, 0, 0, 2), (None, 0, 0, 2)], kind)
    found = views.volumes_differ(a, b, 3)
    assert found.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(0, 0, 0, 1, "left")] * 2 + [(1, 0, 0, 5, "left"), (1, 0, 0, 6, "right"), (None, 0, 0, 2, "right")], key=str)
    assert views.volumes_differ(a, a).collect() == []


def test_a_large_volume_has_partitions_of_its_own(spark, sf_dir, monkeypatch):
    small = derived.voxels(spark, sf_dir)
    rows, one = derived.table(spark, sf_dir, "lineitem").count(), sorted(map(tuple, small.collect()))
    assert derived.parts(spark, sf_dir) is None
    monkeypatch.setattr(derived, "FEW_ROWS", 100)
    monkeypatch.setattr(derived, "PART_ROWS", 700)
    assert derived.voxels(spark, sf_dir).rdd.getNumPartitions() == derived.parts(spark, sf_dir) == -(-rows // 700)
    assert sorted(map(tuple, derived.voxels(spark, sf_dir).collect())) == one


@pytest.mark.parametrize("axes, parts", [("zyx", None), ("yx", 3)])
def test_differences_across_borders_of_chunks(spark, axes, parts):
    rng = random.Random(6)
    rows = [(z, y, x, None if rng.random() < 0.1 else rng.randint(1, 9)) for z in range(-3, 4) for y in range(-3, 4) for x in range(6) if rng.random() < 0.5] + [(0, 0, 0, 4), (50, 50, 50, None), (90, 90, 90, 2), (None, 0, 0, 3)]
    volume = spark.createDataFrame(rows, "z long, y int, x long, v long").repartition(4)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filters.hessian(volume, axes, parts, (2, 3, 4)).collect()}
    light = {}
    for *p, v in rows:
        if v is not None and None not in p:
            light[tuple(p)] = light.get(tuple(p), 0) + v
    assert got.keys() == {tuple(p) for *p, _ in rows if None not in p}
    unit = {a: tuple(int(a == b) for b in "zyx") for a in "zyx"}

    def at(p, *steps):
        return light.get(tuple(c + sum(k * unit[a][i] for a, k in steps) for i, c in enumerate(p)), 0)

    for p, h in got.items():
        want = []
        for i, a in enumerate(axes):
            for b in axes[i:]:
                want.append(at(p, (a, 1)) + at(p, (a, -1)) - 2 * at(p) if a == b else sum(d * e * at(p, (a, d), (b, e)) for d in (-1, 1) for e in (-1, 1)) / 4)
        assert h == ((None,) * len(want) if p == (50, 50, 50) else tuple(want))


def test_chunks_share_files(spark, tmp_path):
    rows = [(z, y, x, 1 + z + 2 * y + 3 * x) for z in range(20) for y in range(5) for x in range(6)]
    volume = spark.createDataFrame(rows, "z long, y long, x long, v long").repartition(4)
    path = f"file://{tmp_path}/v"
    chunks.write_chunks(chunks.to_chunks(volume, (20, 5, 6), (1, 1, 2)), path)
    chunks.write_chunks(chunks.to_chunks(volume.where("x < 3 and y < 2"), (20, 2, 3), (1, 1, 2), level=1), path, "append")
    # One for each sixteen chunks of z and each level, not one for each of 300 and 80 chunks.
    assert len(list((tmp_path / "v").rglob("*.parquet"))) == 4
    found = chunks.layout(spark, path)
    assert found.count() == 300 + 80 and found.select("path").distinct().count() == 4
    assert {tuple(r) for r in found.select("c", "level", "cz", "cy", "cx").collect()} == {(0, level, z, y, x) for level, ny, nx in ((0, 5, 3), (1, 2, 2)) for z in range(20) for y in range(ny) for x in range(nx)}
    block = Block((15, 1, 1), (4, 3, 5), (1, 2, 2))
    got = {tuple(r) for r in chunks.read_block(chunks.read_chunks(spark, path), block, (1, 1, 2)).collect()}
    assert got == {(z - 15, (y - 1) // 2, (x - 1) // 2, float(v)) for z, y, x, v in rows if 15 <= z < 19 and y in (1, 3) and x in (1, 3, 5)}
    none = f"file://{tmp_path}/none"
    chunks.write_chunks(chunks.to_chunks(volume.limit(0), (20, 5, 6), (1, 1, 2)), none)
    assert chunks.layout(spark, none).count() == 0


def test_long_numbers_in_paths_are_whole(spark):
    places = spark.createDataFrame([(1, 7, 3, 40), (1, 13124, 31, 0), (100, 1234567, 123456, 0), (2, None, 0, 0)], "level int, z long, y long, x long")
    path = catalog.chunk_path(F.col("level"), F.col("z"), F.col("y"), F.col("x"), (4, 16, 16))
    found = places.withColumn("path", path).select("path", *[c.alias(k) for k, c in catalog.parsed_path(F.col("path")).items()]).collect()
    assert [r["path"] for r in found[:3]] == [
        "pyr_level_01/z0004_000008/y0000_000016/x0032_000048",
        "pyr_level_01/z13124_013128/y0016_000032/x0000_000016",
        "pyr_level_100/z1234564_1234568/y123456_123472/x0000_000016",
    ]
    assert [(r["level"], r["z0"], r["y0"], r["x0"]) for r in found[1:3]] == [(1, 13124, 16, 0), (100, 1234564, 123456, 0)]
    assert found[3]["z0"] is None
