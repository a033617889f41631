import math
import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dendrovox.functions import boxes
from dendrovox.operators import arrays, components, graphs, neighbours, neurites, patches, similarity, trees, views
from dendrovox.operators.ranking import ranked
from dendrovox.plans import catalog
from dendrovox.plans.components import connected_components
from dendrovox.plans.durable import materialize, shared_root
from dendrovox.plans.paths import climb
from dendrovox.sources import swc
from dendrovox.operators.views import Block, select_view

PYRAMID = [(292, 6197, 5183), (292, 3098, 2591), (146, 1549, 1295), (73, 774, 647), (36, 387, 323)]
TREE = "node_id long, node_type long, x double, y double, z double, radius double, parent_id long"


@pytest.mark.parametrize("level,offsets,extents,strides", [
    (0, (100, 2000, 2000), (64, 2048, 2048), (8, 8, 8)),
    (1, (100, 1000, 1000), (64, 1024, 1024), (8, 4, 4)),
    (2, (50, 500, 500), (32, 512, 512), (4, 2, 2)),
    (3, (25, 250, 250), (16, 256, 256), (2, 1, 1)),
    (4, (12, 125, 125), (8, 128, 128), (1, 1, 1)),
])
def test_views_from_the_whole_volume(level, offsets, extents, strides):
    view = select_view(PYRAMID, Block((100, 2000, 2000), (64, 2048, 2048), (8, 8, 8)), level)
    assert view.local == Block(offsets, extents, strides)


def test_views_at_a_level():
    block = Block((10, 200, 200), (20, 200, 200), (2, 2, 2))
    assert select_view(PYRAMID, block, 1, True).whole == Block((10, 400, 400), (20, 400, 400), (2, 4, 4))
    assert select_view(PYRAMID, block, 2, True).whole == Block((20, 800, 800), (40, 800, 800), (4, 8, 8))
    assert select_view(PYRAMID, Block(), 2).strided_dims == (146, 1549, 1295)
    with pytest.raises(ValueError):
        select_view(PYRAMID, Block((292, 0, 0)))


def test_views_outside():
    dims = [(6, 26604, 22343), (6, 13302, 11171)]
    view = select_view(dims, Block((0, 0, 11171), (100, 100, 100)), 1, True)
    assert view.entirely_outside() and view.partially_outside()
    view = select_view(dims, Block((0, 20000, 20000), (10000, 10000, 10000)))
    assert not view.entirely_outside() and view.partially_outside()
    view = select_view(dims, Block((0, 0, 11170), (1, 100, 2), (1, 1, 2)), 1, True)
    assert not view.entirely_outside() and not view.partially_outside()
    assert views.residual_stride(10, 4) == 2 and views.residual_stride(8, 4) == 0


def test_boxes(spark):
    def row(*bounds):
        return boxes.box(*[F.lit(b) for b in bounds], *[F.lit(None)] * (6 - len(bounds)))

    pairs = [((1, 2, 3, 5, 3, 8), (-1, 3, 2, 4, 5, 6)), ((), (1, 2, 3, 4, 5, 6)), ((2, 5, 1, 6, -1, 3), (3, 7, 1, 6, 0, 1)), ((2, 5, 1, 6, -1, 3), (3, 7, 6, 7, 0, 1))]
    want = [((-1, 3, 2, 5, 3, 8), (1, 2, 3, 4, 5, 6), 10), ((1, 2, 3, 4, 5, 6), None, 0), ((2, 7, 1, 6, -1, 3), (3, 5, 1, 6, 0, 1), 60), ((2, 7, 1, 7, -1, 3), None, 60)]
    for (a, b), (around, shared, size) in zip(pairs, want):
        r = spark.range(1).select(boxes.enclose(row(*a), row(*b)).alias("e"), boxes.intersect(row(*a), row(*b)).alias("i"), boxes.volume(row(*a)).alias("v"), boxes.distance(row(*b), F.lit(0), F.lit(0), F.lit(0)).alias("d")).first()
        assert tuple(r["e"]) == around and (tuple(r["i"]) if r["i"] else None) == shared and r["v"] == size


def test_ranks_have_no_gap(spark):
    rows = [(random.choice("aaab"), random.randint(0, 50)) for _ in range(500)]
    got = ranked(spark.createDataFrame(rows, "g string, k long"), ["g"], F.col("k") % 7, [F.col("k")], "rank").collect()
    for g in "ab":
        mine = sorted((r["k"] % 7, r["k"], r["rank"]) for r in got if r["g"] == g)
        assert sorted(r[2] for r in mine) == list(range(len(mine)))
        assert [r[2] for r in sorted(mine, key=lambda r: r[2])] == list(range(len(mine)))
        assert [r[:2] for r in sorted(mine, key=lambda r: r[2])] == [r[:2] for r in mine]


@pytest.mark.parametrize("a_task", [10, 200_000])
@pytest.mark.parametrize("seed", range(2))
def test_components_match_union_find(spark, seed, a_task, monkeypatch):
    from dendrovox.plans import components as plan

    monkeypatch.setattr(plan, "EDGES_A_TASK", a_task)
    random.seed(seed)
    edges = [(random.randint(0, 120), random.randint(0, 120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(60)] + [(400, 401 + i) for i in range(40)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {a: find(a) for a in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("connectivity", [6, 26])
def test_chunked_labels_equal_whole_labels(spark, connectivity):
    random.seed(connectivity)
    voxels = [(z, y, x) for z in range(5) for y in range(9) for x in range(9) if random.random() < 0.25]
    frame = spark.createDataFrame(voxels, "z long, y long, x long")
    whole = {r["address"]: r["label"] for r in components.label_voxels(frame, (5, 9, 9), connectivity).collect()}
    parts = {r["address"]: r["label"] for r in components.label_chunks(frame, (5, 9, 9), (2, 4, 4), connectivity).collect()}
    assert whole == parts and len(whole) == len(voxels)


def test_shortest_paths_match_brute_force(spark):
    random.seed(6)
    n = 14
    edges = [(random.randrange(n), random.randrange(n), float(random.randint(1, 9))) for _ in range(40)]
    best = {0: 0.0}
    for _ in range(n):
        for u, v, c in edges:
            if u in best and best[u] + c < best.get(v, math.inf):
                best[v] = best[u] + c
    rows = graphs.shortest_paths(spark.createDataFrame(edges, "u long, v long, cost double"), spark.createDataFrame([(0,)], "id long")).collect()
    assert {r["id"]: r["distance"] for r in rows} == best
    cost = {}
    for u, v, c in edges:
        cost[u, v] = min(c, cost.get((u, v), math.inf))
    assert all(r["parent"] is None or best[r["parent"]] + cost[r["parent"], r["id"]] == r["distance"] for r in rows)
    outer = {r["id"] for r in graphs.outer_vertices(graphs.shortest_paths(spark.createDataFrame(edges, "u long, v long, cost double"), spark.createDataFrame([(0,)], "id long"))).collect()}
    assert outer == set(best) - {r["parent"] for r in rows}
    with pytest.raises(ValueError):
        graphs.shortest_paths(spark.createDataFrame([(0, 1, -1.0)], "u long, v long, cost double"), spark.createDataFrame([(0,)], "id long"))


def test_climb_finds_cycles_and_long_chains(spark):
    chain = spark.range(1, 400).selectExpr("id as node_id", "if(id = 1, -1, id - 1) as parent_id")
    got = {r["node_id"]: (r["top"], r["steps"]) for r in climb(chain, F.lit(1).cast("long"), F.col("parent_id") == -1).collect()}
    assert got == {i: (1, i - 1) for i in range(1, 400)}
    with pytest.raises(RuntimeError):
        climb(spark.createDataFrame([(1, 2), (2, 1)], "node_id long, parent_id long"), F.lit(1).cast("long"), F.col("parent_id") == -1, rounds=5)


def small_tree(spark):
    rows = [(1, 1, 0, 0, 0, 2, -1), (2, 0, 1, 0, 0, 1, 1), (3, 0, 2, 0, 0, 1, 2), (4, 0, 3, 1, 0, 1, 3), (5, 0, 3, -1, 0, 1, 3), (6, 0, 4, -1, 0, 1, 5), (7, 0, 5, -1, 0, 1, 6), (8, 0, 0, 3, 0, 1, 1)]
    return spark.createDataFrame([(a, b, *map(float, c), d) for a, b, *c, d in rows], TREE)


def test_tree_basics(spark):
    t = small_tree(spark)
    assert sorted(r[0] for r in trees.leaves(t).select("node_id").collect()) == [4, 7, 8]
    assert {r["node_id"]: r["branch_order"] for r in trees.branch_orders(t).collect()} == {1: 0, 2: 0, 8: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1}
    assert sorted(r[0] for r in trees.prune_short_tips(t, 2).select("node_id").collect()) == [1, 2, 3, 5, 6, 7]
    stable = t.where("node_id = 4").select("node_id")
    assert 4 in {r[0] for r in trees.prune_short_tips(t, 2, stable).select("node_id").collect()}
    again = trees.prune_short_tips(trees.prune_short_tips(t, 2), 2)
    assert again.count() == 6
    gone = {r["node_id"]: r["parent_id"] for r in trees.removed(t, t.where("node_id in (5, 6, 2)").select("node_id")).collect()}
    assert gone == {1: -1, 3: 1, 4: 3, 7: 3, 8: 1}
    m = trees.morphology(t).first()
    assert (m["nodes"], m["branches"], m["tips"], m["stems"]) == (8, 1, 3, 2)
    back = trees.rotated(trees.rotated(t, 0.7), -0.7).orderBy("node_id").collect()
    assert all(math.isclose(a["x"], b["x"], abs_tol=1e-9) for a, b in zip(back, t.orderBy("node_id").collect()))
    assert trees.excess_roots(t.withColumn("tree_id", F.lit(1))).count() == 0


def test_swc_round_trip(spark, tmp_path):
    t = small_tree(spark)
    path = f"file://{tmp_path}/swc"
    swc.write_swc(t, path)
    back = swc.read_swc(spark, path).drop("tree_id")
    assert back.exceptAll(t).count() == 0 and back.count() == t.count()
    swc.write_swc(t, path, ["scaled by 2", "pruned"])
    assert swc.read_swc(spark, path).count() == t.count()
    assert [r["note"] for r in swc.read_notes(spark, path).collect()] == ["scaled by 2", "pruned"]
    lines = spark.createDataFrame([("# c",), ("",), ("1,0,1.5,2,3,1,-1",), ("bad line",)], "value string")
    rows = swc.parse_swc(lines).collect()
    assert len(rows) == 2 and rows[0]["x"] == 1.5 and rows[1]["node_id"] is None
    marks = swc.soma_marks(spark.createDataFrame([("7",), ("1 2 3",)], "value string")).collect()
    assert marks[0]["node_id"] == 7 and marks[1]["z"] == 3.0


def test_percentile_rank_rule(spark):
    values = spark.createDataFrame([(i,) for i in range(1, 64)], "v long")
    for q in (0.05, 0.1, 0.5, 1.0):
        index = min(62, math.ceil((1 - q) * 63 - 0.5))
        assert arrays.top_percentile(values, q).first()[0] == index + 1


def test_point_labels_match_brute_force(spark):
    random.seed(8)
    points = [(i, random.uniform(0, 20), random.uniform(0, 20), random.uniform(0, 20)) for i in range(120)]
    label = {p[0]: p[0] for p in points}
    for _ in range(120):
        for a in points:
            for b in points:
                if math.dist(a[1:], b[1:]) <= 2.5:
                    label[a[0]] = label[b[0]] = min(label[a[0]], label[b[0]])
    got = components.label_points(spark.createDataFrame(points, "id long, x double, y double, z double"), 2.5).collect()
    assert {r["id"]: r["label"] for r in got} == label


def test_catalog(spark, tmp_path):
    good = [(0, k, *dims, 8, 64, 64, "u16", "tiff") for k, dims in enumerate(PYRAMID[:3])]
    frame = spark.createDataFrame(good, catalog.CATALOG)
    assert catalog.violations(frame).count() == 0
    bad = spark.createDataFrame([*good, (1, 0, 292, 6197, 5183, 8, 64, 64, "u16", "tiff"), (1, 1, 292, 6197, 2591, 500, 64, 64, "u16", "tiff")], catalog.CATALOG)
    rules = {(r["c"], r["level"], r["rule"]) for r in catalog.violations(bad).collect()}
    assert (1, 1, "xy ratio is not 2^level") in rules and (1, 1, "chunk larger than the level") in rules and (0, 1, "channels differ in dims") in rules
    path = f"file://{tmp_path}/catalog"
    catalog.save(frame, path)
    assert catalog.load(spark, path).exceptAll(frame).count() == 0
    present = catalog.expected_chunks(frame).where("not (level = 2 and cz = 0 and cy = 1 and cx = 2)")
    assert [tuple(r) for r in catalog.missing_chunks(frame, present).collect()] == [(0, 2, 0, 1, 2)]


def test_tree_assignment_matches_enumeration(spark):
    random.seed(3)
    parents = [(0, None), (1, 0), (2, 0), (3, 1), (4, None), (5, 4)]
    costs = [(n, s, random.random()) for n, _ in parents for s in (10, 20, 30)]
    got = {r["neurite"]: r["soma"] for r in neurites.assign_tree(spark.createDataFrame(costs, "neurite long, soma long, cost double"), spark.createDataFrame(parents, "neurite long, parent long")).collect()}
    for group in ((0, 1, 2, 3), (4, 5)):
        best = min((sum(c for n, s, c in costs if n in group and s == soma), soma) for soma in (10, 20, 30))[1]
        assert all(got[n] == best for n in group)


def test_spatial_distance_of_shifted_lines(spark):
    a = spark.createDataFrame([(i, 0, float(10 * i), 0.0, 0.0, 1.0, i - 1 if i else -1) for i in range(5)], TREE)
    r = similarity.spatial_distance(a, trees.translated(a, dy=3.0)).first()
    assert r["sd"] == r["ssd"] == r["most"] == 3.0 and r["ssd_share"] == 1.0
    r = similarity.spatial_distance(a, a).first()
    assert abs(r["sd"]) < 1e-12 and r["ssd_share"] == 0.0


def brute_spatial_distance(a, b, threshold=2.0):
    """sd, ssd, share and smaller maximum over all pairs of sample points and edges; lines of points in order."""
    def far(p, u, v):
        d = [j - i for i, j in zip(u, v)]
        dd = sum(x * x for x in d)
        t = min(max(sum(x * (y - z) for x, y, z in zip(d, p, u)) / dd, 0), 1) if dd else 0
        return math.dist(p, [x + t * y for x, y in zip(u, d)])

    ways = []
    for one, other in ((a, b), (b, a)):
        found = []
        for u, v in zip(one[1:], one):
            n = math.floor(1.5 + math.dist(u, v))
            for k in range(n):
                p = [x + (y - x) * k / n for x, y in zip(u, v)]
                found.append(min(far(p, x, y) for x, y in zip(other[1:], other)))
        over = [f for f in found if f >= threshold]
        ways.append((sum(found) / len(found), sum(over) / len(over) if over else 0.0, len(over) / len(found), max(found)))
    sd, ssd, share, most = zip(*ways)
    return sum(sd) / 2, sum(ssd) / 2, sum(share) / 2, min(most)


def polyline_tree(spark, points):
    return spark.createDataFrame([(i, 0, *p, 1.0, i - 1 if i else -1) for i, p in enumerate(points)], TREE)


@pytest.mark.parametrize("shift", [0.0, 300.0])
def test_spatial_distance_counts_far_branches(spark, shift):
    random.seed(5)
    a = [tuple(random.uniform(0, 40) for _ in "xyz") for _ in range(12)] + [(200.0, 5.0, 5.0)]
    b = [(random.uniform(0, 40) + shift, random.uniform(0, 40), random.uniform(0, 40)) for _ in range(12)]
    one, other = polyline_tree(spark, a), polyline_tree(spark, b)
    for cell in (4.0, 16.0):
        r = similarity.spatial_distance(one, other, cell=cell).first()
        assert [r[c] for c in ("sd", "ssd", "ssd_share", "most")] == pytest.approx(brute_spatial_distance(a, b), rel=1e-9)
    r = similarity.directional_distance(one, other, 2.0, 16.0).first()
    assert r["points"] == r["near"]


def test_spatial_distance_to_a_tree_without_edges(spark):
    r = similarity.directional_distance(polyline_tree(spark, [(0.0, 0.0, 0.0), (9.0, 0.0, 0.0)]), polyline_tree(spark, [(0.0, 0.0, 0.0)]), 2.0, 16.0).first()
    assert (r["points"], r["near"], r["total"]) == (10, 0, None)


def test_whole_distance_takes_every_point(spark, tmp_path):
    """The two trees are the points of even clouds and those of odd ones, so all three labels take part."""
    from dendrovox import registry

    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.1) for _ in "xyz"], i % 3) for i in range(0, 900, 10)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    points = {r["vec_id"]: tuple(x * 100 for x in r["embedding"]) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    a, b = ([points[i] for i, _, label in rows if label % 2 == side] for side in (0, 1))
    got = registry.queries()["spatial_distance_whole"](spark, str(tmp_path)).first()
    assert [got[c] for c in ("sd", "ssd", "ssd_share", "most")] == pytest.approx(brute_spatial_distance(a, b), abs=2e-6)


def brute_matches(planes, history, decay):
    out = {}
    for at, z in enumerate(sorted(planes)):
        values = sorted(planes[z])
        past = sorted((v, decay**back) for back in range(history) if at > back for v in planes[sorted(planes)[at - back - 1]])
        weight = sum(w for _, w in past)
        for v in set(values):
            share = sum(x <= v for x in values) / len(values)
            out[z, v] = v if at < history else min(p for p, _ in past if sum(w for x, w in past if x <= p) / weight >= share - 1e-12)
            out[z, v] += at >= history and out[z, v] + 1 in {p for p, _ in past}
    return out


@pytest.mark.parametrize("decay", [1.0, 0.5])
def test_histograms_match_brute_force(spark, decay):
    rng = random.Random(2)
    planes = {z: [min(int(rng.expovariate(1 / 60)), 500) for _ in range(60)] for z in (0, 1, 3, 4, 7)}
    frame = spark.createDataFrame([(z, v) for z, values in planes.items() for v in values], "z long, v long")
    matched = arrays.match_histograms(frame, 2, decay)
    assert {(r["z"], r["v"]): r["matched"] for r in matched.collect()} == brute_matches(planes, 2, decay)
    plan = matched._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "_at#" in x]


def test_whole_history_matches_values_of_60_and_more(spark, sf_dir):
    from dendrovox import registry

    planes = {}
    for r in registry.queries()["hist_match_history_whole"](spark, sf_dir).collect():
        planes[r["z"], r["v"]] = r["matched"]
    events = {}
    for z, v in spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("datediff(to_date(ts), '2020-01-01')", "cast(floor(value) as long)").collect():
        events.setdefault(z, []).append(v)
    assert max(v for _, v in planes) > 60 and planes == brute_matches(events, 2, 1.0)


def test_nearest_node_of_targets_without_a_place(spark):
    tree = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 1.0, -1), (2, 0, 5000.0, 0.0, 0.0, 1.0, 1), (3, 0, float("nan"), 0.0, 0.0, 1.0, 1)], TREE)
    targets = spark.createDataFrame([(1, 4000.0, 0.0, 0.0), (2, float("nan"), 0.0, 0.0), (3, None, 1.0, 1.0), (4, float("inf"), 0.0, 0.0), (5, -1.0, 0.0, 0.0)], "target_id long, x double, y double, z double")
    got = {r["target_id"]: (r["node_id"], r["distance"]) for r in trees.nearest_node(tree, targets, 0.5).collect()}
    assert got == {1: (2, 1000.0), 2: (None, None), 3: (None, None), 4: (None, None), 5: (1, 1.0)}
    assert {r["node_id"] for r in trees.nearest_node(tree.limit(0), targets, 1.0).collect()} == {None}


def test_ranks_leave_other_columns_alone(spark):
    frame = spark.createDataFrame([("a", i, 7, 8) for i in range(20)], "g string, k long, _bucket int, _row int")
    got = ranked(frame, ["g"], F.col("k") % 3, [F.col("k")], "_rank").collect()
    assert sorted(r["_rank"] for r in got) == list(range(20)) and {(r["_bucket"], r["_row"]) for r in got} == {(7, 8)}


def test_paths_over_many_parts(spark):
    random.seed(9)
    edges = [(random.randrange(60), random.randrange(60), random.uniform(0.5, 4)) for _ in range(240)]
    best = {0: 0.0, 1: 2.5}
    for _ in range(60):
        for u, v, c in edges:
            if u in best and best[u] + c < best.get(v, math.inf):
                best[v] = best[u] + c
    frame = spark.createDataFrame(edges, "u long, v long, cost double")
    sources = spark.createDataFrame([(0, 0.0), (1, 2.5)], "id long, distance double")
    got = {r["id"]: r["distance"] for r in graphs.shortest_paths(frame, sources, lambda at: at % 7).collect()}
    assert got == pytest.approx(best)
    targets = spark.createDataFrame([(5,), (999,)], "id long")
    state = {r["id"]: r["reached"] for r in graphs.reached(graphs.shortest_paths(frame, sources), targets).collect()}
    assert state == {5: 5 in best, 999: False}
    assert graphs.shortest_paths(frame, sources.limit(0)).count() == 0


def test_chunks_cut_values_and_keep_odd_ends(spark, tmp_path):
    from dendrovox.operators import chunks

    voxels = spark.createDataFrame([(0, 0, 0, 300), (1, 4, 6, -5), (2, 2, 3, 9)], "z long, y long, x long, v long")
    chunks.write_chunks(chunks.to_chunks(voxels, (3, 5, 7), (2, 2, 4), "u8"), f"file://{tmp_path}/v")
    held = chunks.read_chunks(spark, f"file://{tmp_path}/v")
    got = {(r["z"], r["y"], r["x"]): r["v"] for r in chunks.read_block(held, Block((0, 0, 0), (3, 5, 7)), (2, 2, 4)).collect() if r["v"]}
    assert got == {(0, 0, 0): 255.0, (2, 2, 3): 9.0}
    plan = chunks.read_block(held, Block((2, 0, 0), (1, 2, 2)), (2, 2, 4))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [" in plan and "cz#" in plan
    assert chunks.read_block(held, Block((2, 4, 4), (1, 1, 3)), (2, 2, 4)).count() == 0


def test_neurons_turn_round_below_their_soma(spark):
    t = spark.createDataFrame([(i, 0, float(i), 0.0, 0.0, 1.0, p) for i, p in ((1, -1), (2, 1), (3, 2), (4, 3), (5, 3), (6, 5), (7, 2))], TREE)
    nodes = neurites.topology_nodes(t, spark.createDataFrame([(5,)], "node_id long"))
    ends = neurites.neurites(t, nodes).select("lower", F.lit(5).cast("long").alias("soma"))
    got = {r["node_id"]: r["parent_id"] for r in neurites.assembled(t, nodes, ends).collect()}
    assert got == {5: -1, 6: 5, 3: 5, 4: 3, 2: 3, 7: 2, 1: 2}
    cut = neurites.assembled(t, nodes, ends.where("lower <> 3")).collect()
    assert {r["node_id"]: r["parent_id"] for r in cut} == {5: -1, 6: 5, 3: 5, 4: 3}


def _written(spark):
    """Rows of all tables below the shared folder."""
    return sum(pq.read_metadata(f).num_rows for f in Path(shared_root(spark).removeprefix("file://")).rglob("*.parquet"))


def test_rounds_leave_parts_without_offers_alone(spark):
    """A way through 16 parts of 40 vertices: what is written grows with the graph, not with rounds times the graph."""
    n, size = 640, 40
    edges = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(0.5).alias("cost"))
    before = _written(spark)
    found = graphs.shortest_paths(edges, spark.range(1), lambda at: F.floor(at / size)).collect()
    assert sorted((r["id"], r["distance"], r["parent"]) for r in found) == [(i, i / 2, i - 1 if i else None) for i in range(n)]
    assert _written(spark) - before < 4 * n


def test_deep_volumes_have_few_parts(spark):
    """A part is bounded by its places, not by its depth alone: a column of 13,125 planes has 26 parts."""
    dims = (13125, 32, 32)
    places = spark.range(0, 13125 * 1024, 1024)
    sizes = places.groupBy(graphs.voxel_part(dims)(F.col("id")).alias("part")).count().collect()
    assert len(sizes) == 26 and max(r["count"] for r in sizes) * 1024 <= graphs.PART_PLACES


def test_neighbour_links_are_the_pairs_of_a_join(spark):
    dims = (4, 5, 6)
    voxels = spark.range(120).where("id * 7 % 5 < 3").select("id", *[c.alias(a) for a, c in views.coordinates("id", dims).items()])
    for connectivity in (6, 18, 26):
        pairs = neighbours.neighbour_pairs(voxels, connectivity, keep=("id",))
        axes = sum(F.abs(F.col(a) - F.col(f"n_{a}")) for a in "zyx").cast("int")
        plain = pairs.withColumn("n_z", F.floor(F.col("n_id") / 30)).withColumn("n_y", F.floor(F.col("n_id") / 6) % 5).withColumn("n_x", F.col("n_id") % 6).select("id", "n_id", axes)
        links = neighbours.neighbour_links(voxels, dims, connectivity).select("u", "v", "axes")
        assert sorted(map(tuple, links.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("theta", [0.0, 0.5, math.pi / 4, -2.3, math.pi])
def test_rotation_meets_every_place_without_a_grid(spark, theta):
    """Voxels go to their places by themselves: nothing is joined, so no plane is sent anywhere whole."""
    ydim, xdim = 9, 14
    voxels = spark.range(2 * ydim * xdim).select(F.expr(f"id div {ydim * xdim}").alias("z"), F.expr(f"(id div {xdim}) % {ydim}").alias("y"), (F.col("id") % xdim).alias("x"), F.col("id").alias("v"))
    turned = patches.rotated(voxels, (ydim, xdim), theta)
    c, s, my, mx = math.cos(theta), math.sin(theta), (ydim - 1) / 2, (xdim - 1) / 2
    want = []
    for y in range(ydim):
        for x in range(xdim):
            at = [math.floor(abs(p) + 0.5) * (1 if p >= 0 else -1) for p in (my + c * (y - my) + s * (x - mx), mx - s * (y - my) + c * (x - mx))]
            if 0 <= at[0] < ydim and 0 <= at[1] < xdim:
                want += [(z, y, x, (z * ydim + at[0]) * xdim + at[1]) for z in (0, 1)]
    assert sorted(map(tuple, turned.collect())) == sorted(want)
    assert "Join" not in turned._jdf.queryExecution().optimizedPlan().toString()


def test_large_tables_are_not_sent_through_the_driver(spark):
    """60,000 numbers are some 100 KB of Parquet, yet MB once they are rows: such tables are joined by shuffles, small ones are sent."""
    large, small = materialize(spark.range(60_000)), materialize(spark.range(10))
    plans = [large.join(other, "id")._jdf.queryExecution().executedPlan().toString() for other in (large.groupBy("id").count(), materialize(spark.range(60_001)))]
    assert all("BroadcastHashJoin" not in p and "SortMergeJoin" in p for p in plans)
    assert "BroadcastHashJoin" in spark.range(20).join(small, "id")._jdf.queryExecution().executedPlan().toString()
