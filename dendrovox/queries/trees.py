"""Trees, neurites, graphs and similarity over the derived tree, polylines and volume."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrovox.operators import graphs, neurites, similarity, trees, views
from dendrovox.operators.ranking import ranked
from dendrovox.plans.durable import materialize
from dendrovox.queries.volumes import FRONT, front, pairs
from dendrovox.sources import derived, swc
from dendrovox.sources.derived import POINTS, POLYLINES, TREE

SOMA_EVERY = 97
#: A density over (angle - mean) / std, highest power first.
DENSITY, MEAN, STD = [-0.02, 0.0, 0.35], 0.9, 0.6


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.tree(spark, sf_dir)


def degrees(spark, d):
    return trees.degrees(tree(spark, d)).select("node_id", "children", "degree")


def leaves(spark, d):
    return trees.leaves(tree(spark, d)).select("node_id")


def branch_nodes(spark, d):
    return trees.branch_nodes(tree(spark, d))


def branch_order(spark, d):
    return trees.branch_orders(tree(spark, d))


def prune_order(spark, d):
    return trees.prune_above_order(tree(spark, d), 4).select("node_id", "parent_id")


def segments(spark, d):
    found = trees.segments(tree(spark, d))
    return found.groupBy("top").agg(F.count(F.lit(1)).alias("nodes"), F.max("node_id").alias("last"))


def prune_tips(spark, d):
    return trees.prune_short_tips(tree(spark, d), 2, rounds=1).select("node_id", "parent_id")


def prune_tips_stable(spark, d):
    t = tree(spark, d)
    return trees.prune_short_tips(t, 2, stable=t.where("node_id % 3 = 0")).select("node_id", "parent_id")


def transform(spark, d):
    t = trees.rotated(trees.scaled(trees.translated(tree(spark, d), 10, -5, 2), 0.5, 2, 3, 1.5), 0.5)
    return t.select("node_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "radius")])


def to_whole(spark, d):
    t = trees.root_typed(trees.to_whole_volume(tree(spark, d), 2, (3.0, 20.0, 100.0)))
    return t.select("node_id", "node_type", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "radius")])


def standardized(spark, d):
    return trees.standardized(tree(spark, d).where("node_id >= 4 or node_id = 1")).select("node_id", "parent_id", "old_id")


def offset_merge(spark, d):
    t = tree(spark, d)
    both = t.union(trees.offset_ids(t, 1_000_000))
    return trees.tree_labels(both).groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.max("node_id").alias("last"))


def removed(spark, d):
    t = tree(spark, d)
    return trees.removed(t, t.where("node_id % 5 = 0").select("node_id")).select("node_id", "parent_id")


def sphere_overlap(spark, d):
    e = trees.edges(tree(spark, d).withColumn("x", F.col("x") / 500))
    dist = trees.length()
    shared = trees.overlap_volume(dist, F.col("radius"), F.col("p_radius"))
    union = trees.node_volume(F.col("radius")) + trees.node_volume(F.col("p_radius")) - shared
    return e.select("node_id", F.round(shared, 5).alias("overlap"), F.round(union, 5).alias("whole"), (dist + F.col("radius") < F.col("p_radius")).alias("inside"), (F.col("radius") + F.col("p_radius") > dist).alias("meet"))


def resampled(spark, d):
    t = tree(spark, d).withColumn("x", F.col("x") / 100)
    return trees.resampled(t, 10.0).groupBy("node_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("x"), 4).alias("x"), F.round(F.avg("radius"), 6).alias("radius"))


def morphology(spark, d):
    m = trees.morphology(tree(spark, d))
    return m.select(F.round("total_length", 3).alias("total_length"), "nodes", "branches", "tips", "stems", *[F.round(f"{a}{e}", 6).alias(f"{a}{e}") for a in "xyz" for e in ("min", "max")])


def nearest_node(spark, d):
    p = derived.points(spark, d)
    targets = p.where("id % 10 = 0").select(F.col("id").alias("target_id"), "x", "y", "z")
    held = p.where("id % 10 <> 0").select(F.col("id").alias("node_id"), "x", "y", "z")
    found = trees.nearest_node(held, targets, 2.0)
    return found.select("target_id", "node_id", F.round("distance", 6).alias("distance"))


def hierarchical(spark, d):
    return trees.hierarchical_segments(tree(spark, d)).select("node_id", "leaf", "top")


def hierarchical_long(spark, d):
    return trees.hierarchical_segments(tree(spark, d)).where("nodes >= 4").select("leaf", "top", "nodes").distinct()


def dark_segments(spark, d):
    t = tree(spark, d)
    found = trees.hierarchical_segments(t).join(t.select("node_id", "radius"), "node_id")
    sums = found.groupBy("leaf").agg(F.avg("radius").alias("mean"), F.avg((F.col("radius") <= 2).cast("double")).alias("dark"))
    return sums.where("mean <= 3 or dark >= 0.2").select("leaf", F.round("mean", 6).alias("mean"), F.round("dark", 6).alias("dark"))


def swc_roundtrip(spark, d):
    return swc.parse_swc(swc.swc_lines(tree(spark, d)))


def polyline_length(spark, d):
    return neurites.polyline_lengths(derived.polylines(spark, d)).select("line", F.round("length", 5).alias("length"), "points", F.round("mean_radius", 6).alias("mean_radius"))


def polyline_smooth(spark, d):
    return neurites.smoothed_lines(derived.polylines(spark, d)).select("line", F.col("seq.o_orderkey").alias("k"), *[F.round(c, 6).alias(c) for c in "xyz"])


def _angles(spark, d):
    return neurites.fit_angles(derived.polylines(spark, d), F.lit(0.0), F.lit(50.0), F.lit(40.0))


def gof_angle(spark, d):
    return _angles(spark, d).select("line", F.round("angle", 6).alias("angle"))


def gof_cost(spark, d):
    lengths = neurites.polyline_lengths(derived.polylines(spark, d)).select("line", "length")
    p = neurites.tail_probability(F.col("angle"), DENSITY, MEAN, STD)
    return _angles(spark, d).join(lengths, "line").select("line", F.round(p, 6).alias("probability"), F.round(neurites.fit_cost(p, F.col("length")), 5).alias("cost"))


def _somas(t: DataFrame) -> DataFrame:
    return t.where(F.col("node_id") % SOMA_EVERY == 0).select("node_id")


def topo_nodes(spark, d):
    t = tree(spark, d)
    return neurites.topology_nodes(t, _somas(t))


def neurite_table(spark, d):
    t = tree(spark, d)
    return neurites.neurites(t, neurites.topology_nodes(t, _somas(t)))


def gcut_units(spark, d):
    t = tree(spark, d)
    nodes = neurites.topology_nodes(t, _somas(t))
    return neurites.units(neurites.neurites(t, nodes), nodes)


def gcut_unit_somas(spark, d):
    t = tree(spark, d)
    nodes = neurites.topology_nodes(t, _somas(t))
    found = neurites.neurites(t, nodes)
    return neurites.somas_of_units(found, nodes, neurites.units(found, nodes)).groupBy("unit").agg(F.count(F.lit(1)).alias("somas"), F.min("soma").alias("least"))


def gcut_assign(spark, d):
    orders = derived.table(spark, d, "orders")
    costs = orders.groupBy((F.col("o_custkey") % 300).alias("neurite"), (F.col("o_orderkey") % 4).alias("soma")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("cost"))
    every = costs.select("neurite").distinct()
    costs = every.crossJoin(F.broadcast(spark.range(4).withColumnRenamed("id", "soma"))).join(costs, ["neurite", "soma"], "left").na.fill(10_000_000)
    parents = every.withColumn("parent", F.when(F.col("neurite") >= 100, F.col("neurite") - 100))
    return neurites.assign_tree(costs, parents)


def bfs_hops(spark, d):
    dims = derived.dims(spark, d)
    f = front(spark, d).withColumn("address", views.address(dims))
    _, edges = graphs.voxel_graph(f.drop("address"), dims, 26)
    return graphs.hops(edges, f.agg(F.min("address").alias("id")), graphs.voxel_part(dims))


def trapped_hops(spark, d):
    dims = derived.dims(spark, d)
    f = front(spark, d).withColumn("address", views.address(dims))
    _, edges = graphs.voxel_graph(f.drop("address"), dims, 26)
    traps = f.where("(y + x) % 3 = 0").select(F.col("address").alias("id"))
    return graphs.trapped(edges, f.agg(F.min("address").alias("id")), traps, graphs.voxel_part(dims))


def _paths(spark, d):
    dims = derived.dims(spark, d)
    f = front(spark, d).withColumn("address", views.address(dims))
    _, edges = graphs.voxel_graph(f.drop("address"), dims, 26)
    return graphs.shortest_paths(edges, f.agg(F.min("address").alias("id")), graphs.voxel_part(dims))


def dijkstra_cost(spark, d):
    return _paths(spark, d).select("id", F.round("distance", 6).alias("distance"))


def marching_tree(spark, d):
    return _paths(spark, d).select("id", "parent")


def sssp_boundary(spark, d):
    return graphs.outer_vertices(_paths(spark, d)).select("id")


def _pair(spark, d):
    """All points as two trees: those of even clouds and those of odd ones, each a line in order of id."""
    p = derived.points(spark, d).withColumn("side", F.col("cloud") % 2)
    p = materialize(ranked(p, ["side"], F.expr("id div 1024"), [F.col("id")], "_at"))
    before = p.select("side", (F.col("_at") + 1).alias("_at"), F.col("id").alias("parent_id"))
    line = p.join(before, ["side", "_at"], "left").select("side", F.col("id").alias("node_id"), F.lit(0).cast("long").alias("node_type"), "x", "y", "z", F.lit(1.0).alias("radius"), F.coalesce("parent_id", F.lit(-1)).alias("parent_id"))
    line = materialize(line)
    return line.where("side = 0").drop("side"), line.where("side = 1").drop("side")


def _directional(cell: float | None):
    def run(spark, d):
        a, b = _pair(spark, d)
        return similarity.directional_distance(a, b, 2.0, cell or similarity.spacing(b)).select("points", "near", F.round("total", 4).alias("total"), F.round("most", 6).alias("most"), F.round("over_total", 4).alias("over_total"), "over")

    return run


def _spatial(cell: float | None):
    def run(spark, d):
        a, b = _pair(spark, d)
        return similarity.spatial_distance(a, b, cell=cell or similarity.spacing(b)).select(*[F.round(c, 6).alias(c) for c in ("sd", "ssd", "ssd_share", "most")])

    return run


KIDS = "kids AS (SELECT parent_id AS node_id, count(*) AS children FROM tree WHERE parent_id <> -1 GROUP BY 1)"
ORDERS = f"{TREE}, {KIDS}, o(node_id, branch_order, root) AS (SELECT node_id, CAST(0 AS BIGINT), true FROM tree WHERE parent_id = -1 UNION ALL SELECT t.node_id, o.branch_order + CASE WHEN NOT o.root AND k.children > 1 THEN 1 ELSE 0 END, false FROM tree t JOIN o ON t.parent_id = o.node_id JOIN kids k ON k.node_id = o.node_id)"
SEGMENTS = f"{TREE}, {KIDS}, s(node_id, top, depth) AS (SELECT node_id, node_id, 0 FROM tree WHERE parent_id = -1 UNION ALL SELECT t.node_id, CASE WHEN s.depth = 0 OR k.children > 1 THEN t.node_id ELSE s.top END, s.depth + 1 FROM tree t JOIN s ON t.parent_id = s.node_id JOIN kids k ON k.node_id = s.node_id)"
ENDS = "ends AS (SELECT node_id FROM tree WHERE parent_id <> -1 AND node_id NOT IN (SELECT parent_id FROM tree))"
KINDS = f"""{TREE}, {KIDS}, {ENDS}, kinds AS (SELECT t.node_id, CASE WHEN t.node_id % {SOMA_EVERY} = 0 THEN 'soma' WHEN children > 1 THEN 'branch' WHEN e.node_id IS NOT NULL OR t.parent_id = -1 THEN 'leaf' END AS kind FROM tree t LEFT JOIN kids k ON k.node_id = t.node_id LEFT JOIN ends e ON e.node_id = t.node_id)"""
NEURITES = f"""{KINDS}, topo AS (SELECT * FROM kinds WHERE kind IS NOT NULL), walk(lower, pos, inner_) AS (SELECT t.node_id, tree.parent_id, CAST(0 AS BIGINT) FROM topo t JOIN tree USING (node_id) WHERE tree.parent_id <> -1
    UNION ALL SELECT lower, tree.parent_id, inner_ + 1 FROM walk JOIN tree ON tree.node_id = walk.pos WHERE walk.pos NOT IN (SELECT node_id FROM topo)), neurites AS (SELECT lower, pos AS upper, inner_ AS n_inner FROM walk WHERE pos IN (SELECT node_id FROM topo))"""
UNITS = f"""{NEURITES}, links AS (SELECT lower AS u, upper AS w FROM neurites JOIN topo a ON a.node_id = lower JOIN topo b ON b.node_id = upper WHERE a.kind <> 'soma' AND b.kind <> 'soma'), both_ AS (SELECT u, w FROM links UNION SELECT w, u FROM links),
    reach(u, w) AS (SELECT node_id, node_id FROM topo WHERE kind <> 'soma' UNION SELECT reach.u, both_.w FROM reach JOIN both_ ON both_.u = reach.w), units AS (SELECT u AS node_id, min(w) AS unit FROM reach GROUP BY 1)"""
HIER = f"""{TREE}, {ENDS}, w(node_id, total, depth) AS (SELECT node_id, CAST(0 AS DOUBLE), 0 FROM tree WHERE parent_id = -1 UNION ALL SELECT t.node_id, w.total + t.radius, w.depth + 1 FROM tree t JOIN w ON t.parent_id = w.node_id),
    up(leaf, pos, total) AS (SELECT node_id, node_id, total FROM ends JOIN w USING (node_id) UNION ALL SELECT leaf, parent_id, total FROM up JOIN tree ON tree.node_id = up.pos WHERE parent_id <> -1),
    best AS (SELECT pos AS node_id, leaf FROM (SELECT pos, leaf, row_number() OVER (PARTITION BY pos ORDER BY total DESC, leaf DESC) AS r FROM up) WHERE r = 1),
    tops AS (SELECT leaf, arg_min(node_id, depth) AS top, count(*) AS nodes FROM best JOIN w USING (node_id) GROUP BY 1)"""
STEPS = f"{POLYLINES}, s AS (SELECT *, lead(x) OVER o AS nx, lead(y) OVER o AS ny, lead(z) OVER o AS nz FROM polylines WINDOW o AS (PARTITION BY line ORDER BY d, k))"
ANGLES = f"""{STEPS}, a AS (SELECT line, avg(acos(least(greatest(((nx - x) * (x - 0.0) + (ny - y) * (y - 50.0) + (nz - z) * (z - 40.0)) / ((sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y) + (nz - z) * (nz - z)) + CAST(1e-10 AS DOUBLE)) * (sqrt(x * x + (y - 50.0) * (y - 50.0) + (z - 40.0) * (z - 40.0)) + CAST(1e-10 AS DOUBLE))), -1.0), 1.0))) AS angle FROM s WHERE nx IS NOT NULL GROUP BY 1)"""


def _horner(coefficients: list[float], x: str) -> str:
    out = "CAST(0 AS DOUBLE)"
    for c in coefficients:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


_WHOLE = neurites.integral(DENSITY)
_LOW, _HIGH = (_horner(_WHOLE, f"CAST({v!r} AS DOUBLE)") for v in ((0.0 - MEAN) / STD, (math.pi - MEAN) / STD))
_P = f"(1 - least(greatest(({_horner(_WHOLE, f'((angle - CAST({MEAN} AS DOUBLE)) / CAST({STD} AS DOUBLE))')} - {_LOW}) / ({_HIGH} - {_LOW}), 0.0), 1.0))"
DIST = "sqrt((t.x / 500 - p.x / 500) * (t.x / 500 - p.x / 500) + (t.y - p.y) * (t.y - p.y) + (t.z - p.z) * (t.z - p.z))"
BALL = f"CAST({4 / 3 * math.pi!r} AS DOUBLE)"
GRAPH = f"""{FRONT}, g AS (SELECT *, exp(10 * (1 - CAST(v AS DOUBLE) / m) * (1 - CAST(v AS DOUBLE) / m)) AS value FROM front, (SELECT max(v) AS m FROM front)),
    {pairs(3, ", a.v AS uv, b.v AS wv, abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) AS step, (a.y + a.x) % 3 = 0 AS trap")},
    edges AS MATERIALIZED (SELECT u, w, trap, sqrt(step) * (a.value + b.value) / 2 AS cost FROM pairs JOIN g a ON a.address = u JOIN g b ON b.address = w),
    src AS (SELECT min(address) AS id FROM front)"""


def _levels(where: str) -> str:
    return f"""WITH RECURSIVE {GRAPH}, b(id, hops) USING KEY (id) AS (SELECT id, CAST(0 AS BIGINT) FROM src UNION SELECT e.w, min(x.hops + 1) FROM b x JOIN edges e ON e.u = x.id LEFT JOIN recurring.b c ON c.id = e.w WHERE (c.id IS NULL OR x.hops + 1 < c.hops) {where} GROUP BY e.w) SELECT id, hops FROM b"""


PATHS = f"""{GRAPH}, d(id, distance) USING KEY (id) AS (SELECT id, CAST(0 AS DOUBLE) FROM src UNION SELECT e.w, min(x.distance + e.cost) FROM d x JOIN edges e ON e.u = x.id LEFT JOIN recurring.d c ON c.id = e.w WHERE c.id IS NULL OR x.distance + e.cost < c.distance GROUP BY e.w),
    up AS (SELECT v.id, min(u.id) AS parent FROM d v JOIN edges e ON e.w = v.id JOIN d u ON u.id = e.u WHERE u.distance < v.distance AND u.distance + e.cost <= v.distance * (1 + 1e-9) GROUP BY 1)"""


LINES = f"{POINTS}, l AS (SELECT cloud, id, x, y, z, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(z) OVER o AS pz FROM (SELECT id, cloud % 2 AS cloud, x, y, z FROM points) WINDOW o AS (PARTITION BY cloud ORDER BY id)), e AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) AS len FROM l WHERE px IS NOT NULL), n AS (SELECT *, CAST(floor(1.5 + len) AS BIGINT) AS n FROM e), q AS (SELECT cloud, id, k, x + (px - x) * k / n AS qx, y + (py - y) * k / n AS qy, z + (pz - z) * k / n AS qz FROM (SELECT *, unnest(range(n)) AS k FROM n))"
_T = "least(greatest(CASE WHEN len > 0 THEN ((px - x) * (qx - x) + (py - y) * (qy - y) + (pz - z) * (qz - z)) / ((px - x) * (px - x) + (py - y) * (py - y) + (pz - z) * (pz - z)) ELSE 0.0 END, 0.0), 1.0)"
FAR = f"{LINES}, m AS (SELECT q.cloud, q.id, q.k, min(sqrt((qx - x - {_T} * (px - x)) ** 2 + (qy - y - {_T} * (py - y)) ** 2 + (qz - z - {_T} * (pz - z)) ** 2)) AS f FROM q JOIN e ON e.cloud <> q.cloud GROUP BY 1, 2, 3)"

#: With tips of one node a round takes every leaf whose parent branches; 30 rounds are more than the tree has levels.
_ROUNDS = 30


def _round(k: int) -> str:
    """Tips of the tree that is left: a leaf goes unless it is stable, the root or the only child of its parent (but for the root's)."""
    t = f"t{k}"
    return f"""t{k + 1} AS MATERIALIZED (SELECT a.node_id, a.parent_id FROM {t} a LEFT JOIN (SELECT DISTINCT parent_id AS p FROM {t}) kids ON kids.p = a.node_id LEFT JOIN (SELECT parent_id AS p, count(*) AS n FROM {t} GROUP BY 1) sib ON sib.p = a.parent_id LEFT JOIN {t} up ON up.node_id = a.parent_id
        WHERE a.parent_id = -1 OR kids.p IS NOT NULL OR a.node_id % 3 = 0 OR NOT (sib.n > 1 OR up.parent_id = -1))"""


SETTLED = f"WITH {TREE}, t0 AS (SELECT node_id, parent_id FROM tree), " + ", ".join(map(_round, range(_ROUNDS))) + f" SELECT node_id, parent_id FROM t{_ROUNDS}"
DIRECTIONAL = f"WITH {FAR} SELECT count(*) AS points, count(*) AS near, round(sum(f), 4) AS total, round(max(f), 6) AS most, round(sum(CASE WHEN f >= 2 THEN f END), 4) AS over_total, count(CASE WHEN f >= 2 THEN 1 END) AS over FROM m WHERE cloud = 0"
SPATIAL = f"WITH {FAR}, w AS (SELECT cloud, avg(f) AS sd, coalesce(avg(CASE WHEN f >= 2 THEN f END), 0.0) AS ssd, avg(CASE WHEN f >= 2 THEN 1.0 ELSE 0.0 END) AS share, max(f) AS most FROM m GROUP BY 1) SELECT round(avg(sd), 6) AS sd, round(avg(ssd), 6) AS ssd, round(avg(share), 6) AS ssd_share, round(min(most), 6) AS most FROM w"

QUERIES = {
    "tree_degree": (degrees, f"WITH {TREE}, {KIDS} SELECT t.node_id, coalesce(children, 0) AS children, coalesce(children, 0) + CASE WHEN parent_id <> -1 THEN 1 ELSE 0 END AS degree FROM tree t LEFT JOIN kids USING (node_id)"),
    "tree_leaves": (leaves, f"WITH {TREE}, {ENDS} SELECT node_id FROM ends"),
    "tree_branch_nodes": (branch_nodes, f"WITH {TREE}, {KIDS} SELECT node_id, children FROM kids WHERE children > 1"),
    "tree_branch_order": (branch_order, f"WITH RECURSIVE {ORDERS} SELECT node_id, branch_order FROM o"),
    "tree_prune_order": (prune_order, f"WITH RECURSIVE {ORDERS} SELECT node_id, parent_id FROM tree JOIN o USING (node_id) WHERE branch_order <= 4"),
    "tree_segments": (segments, f"WITH RECURSIVE {SEGMENTS} SELECT top, count(*) AS nodes, max(node_id) AS last FROM s GROUP BY 1"),
    "tree_prune_short_leaves": (prune_tips, f"WITH RECURSIVE {SEGMENTS}, {ENDS}, short AS (SELECT top FROM s GROUP BY 1 HAVING count(*) < 2) SELECT node_id, parent_id FROM tree WHERE parent_id = -1 OR node_id NOT IN (SELECT s.node_id FROM s JOIN s l ON l.top = s.top JOIN ends ON ends.node_id = l.node_id WHERE s.top IN (SELECT top FROM short))"),
    "tree_prune_settles": (prune_tips_stable, SETTLED),
    "tree_transform": (transform, f"WITH {TREE}, m AS (SELECT node_id, (x + 10) * 0.5 AS x, (y - 5) * 2 AS y, (z + 2) * 3 AS z, radius * 1.5 AS radius FROM tree) SELECT node_id, round(x * cos(0.5) - y * sin(0.5), 6) AS x, round(x * sin(0.5) + y * cos(0.5), 6) AS y, round(z, 6) AS z, round(radius, 6) AS radius FROM m"),
    "tree_to_whole_volume": (to_whole, f"WITH {TREE} SELECT node_id, CAST(CASE WHEN parent_id = -1 THEN 1 ELSE 0 END AS BIGINT) AS node_type, round(x * 4 + 100, 6) AS x, round(y * 4 + 20, 6) AS y, round(z + 3, 6) AS z, round(radius * pow(16.0, 1.0 / 3), 6) AS radius FROM tree"),
    "tree_standardize": (standardized, f"WITH {TREE}, k AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN parent_id = -1 THEN -1 ELSE 0 END, node_id) AS n FROM tree WHERE node_id >= 4 OR node_id = 1) SELECT a.n AS node_id, coalesce(b.n, -1) AS parent_id, a.node_id AS old_id FROM k a LEFT JOIN k b ON b.node_id = a.parent_id"),
    "tree_offset_merge": (offset_merge, f"WITH {TREE} SELECT CAST(o + 1 AS BIGINT) AS root, count(*) AS nodes, max(node_id) + o AS last FROM tree, (VALUES (0), (1000000)) v(o) GROUP BY o"),
    "tree_remove_nodes": (removed, f"WITH RECURSIVE {TREE}, u(node_id, pos) AS (SELECT node_id, parent_id FROM tree WHERE node_id % 5 <> 0 UNION ALL SELECT u.node_id, t.parent_id FROM u JOIN tree t ON t.node_id = u.pos WHERE u.pos % 5 = 0) SELECT node_id, pos AS parent_id FROM u WHERE pos = -1 OR pos % 5 <> 0"),
    "sphere_overlap_volume": (sphere_overlap, f"""WITH {TREE}, e AS (SELECT t.node_id, {DIST} AS d, t.radius AS r, p.radius AS s FROM tree t JOIN tree p ON p.node_id = t.parent_id), v AS (SELECT *, CASE WHEN d >= r + s THEN 0.0 WHEN d <= abs(r - s) THEN {BALL} * pow(least(r, s), 3) ELSE pi() * pow(r + s - d, 2) * (d * d + 2 * d * (r + s) - 3 * (r - s) * (r - s)) / (12 * d) END AS o FROM e)
        SELECT node_id, round(o, 5) AS overlap, round({BALL} * pow(r, 3) + {BALL} * pow(s, 3) - o, 5) AS whole, d + r < s AS inside, r + s > d AS meet FROM v"""),
    "tree_resample": (resampled, f"WITH {TREE}, e AS (SELECT t.node_id, t.x / 100 AS x, p.x / 100 AS px, t.radius AS r, p.radius AS pr, sqrt((t.x / 100 - p.x / 100) ** 2 + (t.y - p.y) ** 2 + (t.z - p.z) ** 2) AS len FROM tree t JOIN tree p ON p.node_id = t.parent_id), k AS (SELECT *, unnest(range(CAST(floor(len / 10) AS BIGINT) + 1)) AS k FROM e) SELECT node_id, count(*) AS points, round(sum(x + (px - x) * CASE WHEN len > 0 THEN k * 10.0 / len ELSE 0 END), 4) AS x, round(avg(r + (pr - r) * CASE WHEN len > 0 THEN k * 10.0 / len ELSE 0 END), 6) AS radius FROM k GROUP BY 1"),
    "neuron_morphology": (morphology, f"WITH {TREE}, {KIDS}, {ENDS} SELECT (SELECT round(sum(sqrt((t.x - p.x) ** 2 + (t.y - p.y) ** 2 + (t.z - p.z) ** 2)), 3) FROM tree t JOIN tree p ON p.node_id = t.parent_id) AS total_length, count(*) AS nodes, (SELECT count(*) FROM kids JOIN tree USING (node_id) WHERE children > 1 AND parent_id <> -1) AS branches, (SELECT count(*) FROM ends) AS tips, (SELECT children FROM kids JOIN tree USING (node_id) WHERE parent_id = -1) AS stems, " + ", ".join(f"round({f}({a}), 6) AS {a}{f}" for a in "xyz" for f in ("min", "max")) + " FROM tree"),
    "nearest_node": (nearest_node, f"WITH {POINTS}, m AS (SELECT a.id AS target_id, b.id AS node_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance FROM points a, points b WHERE a.id % 10 = 0 AND b.id % 10 <> 0) SELECT target_id, node_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY distance, node_id) AS r FROM m) WHERE r = 1"),
    "hier_segments": (hierarchical, f"WITH RECURSIVE {HIER} SELECT node_id, leaf, top FROM best JOIN tops USING (leaf)"),
    "hier_prune_length": (hierarchical_long, f"WITH RECURSIVE {HIER} SELECT leaf, top, nodes FROM tops WHERE nodes >= 4"),
    "dark_segments": (dark_segments, f"WITH RECURSIVE {HIER}, s AS (SELECT leaf, avg(radius) AS mean, avg(CASE WHEN radius <= 2 THEN 1.0 ELSE 0.0 END) AS dark FROM best JOIN tree USING (node_id) GROUP BY 1) SELECT leaf, round(mean, 6) AS mean, round(dark, 6) AS dark FROM s WHERE mean <= 3 OR dark >= 0.2"),
    "swc_roundtrip": (swc_roundtrip, f"WITH {TREE} SELECT * FROM tree"),
    "polyline_length": (polyline_length, f"WITH {STEPS} SELECT line, round(coalesce(sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y) + (nz - z) * (nz - z))), 0.0), 5) AS length, count(*) AS points, round(avg(radius), 6) AS mean_radius FROM s GROUP BY 1"),
    "polyline_smooth": (polyline_smooth, f"WITH {POLYLINES} SELECT line, k, " + ", ".join(f"round(CASE WHEN lag({c}) OVER o IS NULL OR lead({c}) OVER o IS NULL THEN {c} ELSE (coalesce(lag({c}, 2) OVER o, 0) + 2 * lag({c}) OVER o + 3 * {c} + 2 * lead({c}) OVER o + coalesce(lead({c}, 2) OVER o, 0)) / (7.0 + CASE WHEN lag({c}, 2) OVER o IS NULL THEN 0 ELSE 1 END + CASE WHEN lead({c}, 2) OVER o IS NULL THEN 0 ELSE 1 END) END, 6) AS {c}" for c in "xyz") + " FROM polylines WINDOW o AS (PARTITION BY line ORDER BY d, k)"),
    "gof_angle": (gof_angle, f"WITH {ANGLES} SELECT line, round(angle, 6) AS angle FROM a"),
    "gof_probability": (gof_cost, f"WITH {ANGLES}, l AS (SELECT line, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y) + (nz - z) * (nz - z))) AS length FROM s GROUP BY 1) SELECT line, round({_P}, 6) AS probability, round((1 - {_P} * ln(2.0)) * ln(1 + length), 5) AS cost FROM a JOIN l USING (line)"),
    "topo_nodes": (topo_nodes, f"WITH {KINDS} SELECT node_id, kind FROM kinds WHERE kind IS NOT NULL"),
    "neurites": (neurite_table, f"WITH RECURSIVE {NEURITES} SELECT lower, upper, n_inner FROM neurites"),
    "gcut_units": (gcut_units, f"WITH RECURSIVE {UNITS} SELECT node_id, unit FROM units"),
    "gcut_unit_somas": (gcut_unit_somas, f"WITH RECURSIVE {UNITS}, p AS (SELECT lower AS soma, upper AS node_id FROM neurites UNION SELECT upper, lower FROM neurites), j AS (SELECT DISTINCT unit, soma FROM p JOIN units USING (node_id) JOIN topo ON topo.node_id = soma WHERE kind = 'soma') SELECT unit, count(*) AS somas, min(soma) AS least FROM j GROUP BY 1"),
    "gcut_assign": (gcut_assign, "WITH c AS (SELECT o_custkey % 300 AS neurite, o_orderkey % 4 AS soma, CAST(sum(floor(o_totalprice)) AS BIGINT) AS cost FROM orders GROUP BY 1, 2), n AS (SELECT DISTINCT neurite FROM c), f AS (SELECT n.neurite, s.range AS soma, coalesce(cost, 10000000) AS cost FROM n CROSS JOIN range(4) s LEFT JOIN c ON c.neurite = n.neurite AND c.soma = s.range), g AS (SELECT neurite % 100 AS grp, soma, sum(cost) AS cost FROM f GROUP BY 1, 2), b AS (SELECT grp, soma FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY cost, soma) AS r FROM g) WHERE r = 1) SELECT neurite, soma FROM n JOIN b ON grp = neurite % 100"),
    "bfs_hops": (bfs_hops, _levels("")),
    "bfs_trapped": (trapped_hops, _levels("AND (x.hops = 0 OR NOT e.trap)")),
    "dijkstra_cost": (dijkstra_cost, f"WITH RECURSIVE {PATHS} SELECT id, round(distance, 6) AS distance FROM d"),
    "marching_tree": (marching_tree, f"WITH RECURSIVE {PATHS} SELECT d.id, parent FROM d LEFT JOIN up ON up.id = d.id"),
    "sssp_boundary": (sssp_boundary, f"WITH RECURSIVE {PATHS} SELECT id FROM d WHERE id NOT IN (SELECT parent FROM up)"),
    "directional_distance": (_directional(40.0), DIRECTIONAL),
    "spatial_distance": (_spatial(40.0), SPATIAL),
    "directional_distance_whole": (_directional(None), DIRECTIONAL),
    "spatial_distance_whole": (_spatial(None), SPATIAL),
}
