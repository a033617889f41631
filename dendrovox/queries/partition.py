"""Neurites, roads, neurons, depth-first trees and distance transforms over the derived tree and volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrovox.operators import arrays, components, graphs, neurites, trees, views
from dendrovox.queries.trees import ENDS, NEURITES, ORDERS, PATHS, SEGMENTS, SOMA_EVERY, UNITS, _somas, tree
from dendrovox.queries.volumes import FRONT, front, pairs
from dendrovox.sources import derived
from dendrovox.sources.derived import POINTS, POLYLINES, TREE, VOXELS
from dendrovox.streaming import histograms


def _topology(spark, d):
    t = tree(spark, d)
    nodes = neurites.topology_nodes(t, _somas(t))
    return t, nodes, neurites.neurites(t, nodes)


def neurite_nodes(spark, d):
    t, nodes, _ = _topology(spark, d)
    return neurites.neurite_nodes(t, nodes).withColumnRenamed("at", "place")


def neurite_trees(spark, d):
    t, nodes, _ = _topology(spark, d)
    lines = neurites.neurite_lines(t, nodes)
    return lines.select("lower", "node_id", "parent_id", "old_id", "node_type", F.round("x", 6).alias("x"), "radius")


def neurite_directions(spark, d):
    _, nodes, found = _topology(spark, d)
    return neurites.directed(found, nodes)


def tree_resample_segments(spark, d):
    t = tree(spark, d).withColumn("x", F.col("x") / 100)
    return neurites.resampled_segments(t, 10.0).select("lower", "k", *[F.round(c, 5).alias(c) for c in ("x", "y", "z", "radius")])


def tree_prune_dark(spark, d):
    return trees.prune_dark(tree(spark, d), "radius", 3.0).select("node_id", "parent_id")


def contour_nearest(spark, d):
    lines = derived.polylines(spark, d).withColumn("contour", F.col("line") % 101)
    rings = neurites.contours(lines).withColumnRenamed("contour", "node_id")
    roots = tree(spark, d).select(F.col("node_id").alias("target_id"), (F.col("x") / 100).alias("x"), "y", "z")
    found = trees.nearest_node(rings.select("node_id", *[F.col(f"c{a}").alias(a) for a in "xyz"]), roots, 8.0)
    return found.join(rings.select("node_id", F.round("radius", 5).alias("radius")), "node_id").select("target_id", "node_id", F.round("distance", 5).alias("distance"), "radius")


def hist_match_feedback(spark, d):
    planes = derived.planes(spark, d).select((F.col("i") % 5).alias("sequence"), "z", "v")
    return histograms.match_with_feedback(planes, 3, 0.8)


#: Means and deviations of angles: region, then species, then cell type.
ANGLES = {"1": (0.8, 0.5), "3": (0.9, 0.6), "MACHINERY": (1.0, 0.4), "AUTOMOBILE": (0.7, 0.3), "cell": (1.1, 0.7)}


def distribution_keys(spark, d):
    c = derived.table(spark, d, "customer")
    found = neurites.distribution_for(ANGLES, F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "cell"))
    return c.select(F.col("c_custkey").alias("id"), found["mean"].alias("mean"), found["std"].alias("std"))


def gcut_roads(spark, d):
    _, nodes, found = _topology(spark, d)
    return neurites.roads(found, nodes, neurites.units(found, nodes))


def gcut_decisions(spark, d):
    _, nodes, found = _topology(spark, d)
    return neurites.decision_costs(neurites.roads(found, nodes, neurites.units(found, nodes)), found.select("lower", (F.col("n_inner") + 1).alias("cost")))


def trace_sources(spark, d):
    dims = derived.dims(spark, d)
    marks = derived.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 70 - 3 + 0.5).alias("x"), (F.col("o_custkey") % 68 - 2 + 0.25).alias("y"), (F.col("o_orderkey") % 9 + 0.75).alias("z"))
    half = arrays.pyramid(derived.voxels(spark, d), "max")
    return views.placed_markers(marks, half, (dims[0], 16, 16), 1, 4).select("id", "lz", "ly", "lx", "usable")


def soma_crops(spark, d):
    found = components.label_points(derived.points(spark, d), 3.0)
    return views.crops(found, "label", 2.0, 16.0).select("label", "overlaps", *[F.round(f"{a}{e}", 5).alias(f"{a}{e}") for a in "zyx" for e in ("min", "max")])


def _assigned(found, nodes):
    units = neurites.units(found, nodes)
    least = neurites.somas_of_units(found, nodes, units).groupBy("unit").agg(F.min("soma").alias("soma"))
    return neurites.neurite_units(found, nodes, units).join(least, "unit").select("lower", "soma")


def gcut_neurons(spark, d):
    t, nodes, found = _topology(spark, d)
    return neurites.assembled(t, nodes, _assigned(found, nodes))


def tree_depth_first(spark, d):
    t = tree(spark, d).withColumns({"x": F.floor(F.col("x") / 5000), "y": F.col("y") % 2, "z": F.col("z") % 2})
    return trees.sorted_tree(t).select("node_id", "parent_id", "old_id")


def tree_prune_length(spark, d):
    return trees.prune_by_length(tree(spark, d), 2500.0).select("node_id", "parent_id")


def tree_add_nodes(spark, d):
    t = tree(spark, d)
    more = t.select((F.col("node_id") * 2).alias("node_id"), "node_type", "x", "y", "z", "radius", (F.col("node_id") * 3).alias("parent_id"))
    return trees.added(t, more).select("node_id", "parent_id")


def link_counts(spark, d):
    return trees.degree_counts(tree(spark, d))


def tree_bifurcations(spark, d):
    return trees.bifurcations(tree(spark, d), 5)


def distance_transform(spark, d):
    return graphs.distance_transform(front(spark, d), derived.dims(spark, d)).select("z", "y", "x", F.round("distance", 6).alias("distance"))


def auto_soma(spark, d):
    found = graphs.soma_seed(graphs.distance_transform(front(spark, d), derived.dims(spark, d)).withColumn("distance", F.round("distance", 6)))
    return found.select("z", "y", "x", "distance")


def _targets(f, spark, d):
    return f.where("(y * 5 + x * 3 + z) % 61 = 0").select("address")


def path_targets(spark, d):
    dims = derived.dims(spark, d)
    f = front(spark, d).withColumn("address", graphs.address(dims))
    _, edges = graphs.voxel_graph(f.drop("address"), dims, 26)
    paths = graphs.shortest_paths(edges, f.agg(F.min("address").alias("id")), graphs.voxel_part(dims))
    return graphs.reached(paths, _targets(f, spark, d).withColumnRenamed("address", "id")).select("id", "reached", F.round("distance", 6).alias("distance"))


def tree_to_targets(spark, d):
    dims = derived.dims(spark, d)
    f = front(spark, d).withColumn("address", graphs.address(dims))
    _, edges = graphs.voxel_graph(f.drop("address"), dims, 26)
    paths = graphs.shortest_paths(edges, f.agg(F.min("address").alias("id")), graphs.voxel_part(dims))
    return graphs.traced(paths, _targets(f, spark, d).withColumnRenamed("address", "id")).select("id", "parent")


NODES = f"{NEURITES}, held AS (SELECT w.lower, n.upper, w.pos AS node_id, w.inner_ + 1 AS place FROM walk w JOIN neurites n ON n.lower = w.lower UNION ALL SELECT lower, upper, lower, 0 FROM neurites)"
PLAIN = NODES.replace(f"WHEN t.node_id % {SOMA_EVERY} = 0 THEN 'soma' ", "")
PLACED = f"""{UNITS}, placed AS (SELECT lower, upper, coalesce(a.unit, b.unit) AS unit FROM neurites LEFT JOIN units a ON a.node_id = lower LEFT JOIN units b ON b.node_id = upper),
    pairs_ AS (SELECT lower AS soma, upper AS node_id FROM neurites UNION SELECT upper, lower FROM neurites), members AS (SELECT DISTINCT unit, soma FROM pairs_ JOIN units USING (node_id) JOIN topo ON topo.node_id = soma WHERE kind = 'soma')"""
ROADS = f"""{PLACED}, totals AS (SELECT unit, count(*) AS somas FROM members GROUP BY 1 HAVING count(*) > 1), r AS (SELECT p.*, somas, t.kind AS lk, u.kind AS uk FROM placed p JOIN totals USING (unit) JOIN topo t ON t.node_id = lower JOIN topo u ON u.node_id = upper),
    below(e, pos) AS (SELECT lower, lower FROM r WHERE lk = 'soma' UNION ALL SELECT below.e, r.lower FROM below JOIN r x ON x.lower = below.pos AND x.uk <> 'soma' JOIN r ON r.lower = x.upper),
    m AS (SELECT r.*, coalesce(n, 0) AS total, coalesce(n, 0) > 0 AND coalesce(n, 0) < somas AS free FROM r LEFT JOIN (SELECT pos, count(*) AS n FROM below GROUP BY 1) b ON b.pos = r.lower),
    on_ AS (SELECT lower AS node_id, unit FROM m WHERE free UNION SELECT upper, unit FROM m WHERE free),
    climb(e, pos) AS (SELECT lower, lower FROM m WHERE total = 0 UNION ALL SELECT climb.e, y.lower FROM climb JOIN m x ON x.lower = climb.pos AND x.uk <> 'soma' JOIN m y ON y.lower = x.upper AND y.total = 0),
    tops AS (SELECT c.e, c.pos AS entry FROM climb c WHERE NOT EXISTS (SELECT 1 FROM m x JOIN m y ON y.lower = x.upper AND y.total = 0 WHERE x.lower = c.pos AND x.uk <> 'soma')),
    crown AS (SELECT m.unit, min(lower) AS crown FROM m JOIN on_ ON on_.node_id = lower AND on_.unit = m.unit WHERE total = somas GROUP BY 1)"""

QUERIES = {
    "neurite_nodes": (neurite_nodes, f"WITH RECURSIVE {NODES} SELECT lower, upper, node_id, place FROM held"),
    "hist_match_feedback": (hist_match_feedback, None),
    "tree_prune_dark": (tree_prune_dark, f"WITH RECURSIVE {TREE}, up(node_id) AS (SELECT node_id FROM tree WHERE radius > 3 UNION SELECT parent_id FROM up JOIN tree USING (node_id)) SELECT node_id, parent_id FROM tree WHERE parent_id = -1 OR node_id IN (SELECT node_id FROM up)"),
    "tree_resample_segments": (tree_resample_segments, f"""WITH RECURSIVE {PLAIN}, q AS (SELECT h.lower, place, t.x / 100 AS x, t.y, t.z, t.radius AS r FROM held h JOIN tree t USING (node_id)), n AS (SELECT *, lead(x) OVER o AS nx, lead(y) OVER o AS ny, lead(z) OVER o AS nz, lead(r) OVER o AS nr FROM q WINDOW o AS (PARTITION BY lower ORDER BY place)),
        l AS (SELECT *, sqrt((nx - x) ** 2 + (ny - y) ** 2 + (nz - z) ** 2) AS len FROM n), f AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY lower ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
        k AS (SELECT *, unnest(range(CAST(ceil(round(start / 10, 9)) AS BIGINT), CAST(ceil(round((start + len) / 10, 9)) AS BIGINT))) AS k FROM f WHERE nx IS NOT NULL), p AS (SELECT *, CASE WHEN len > 0 THEN (k * 10.0 - start) / len ELSE 0 END AS t FROM k)
        SELECT lower, k, round(x + (nx - x) * t, 5) AS x, round(y + (ny - y) * t, 5) AS y, round(z + (nz - z) * t, 5) AS z, round(r + (nr - r) * t, 5) AS radius FROM p UNION ALL SELECT lower, CAST(ceil(round(start / 10, 9)) AS BIGINT), round(x, 5), round(y, 5), round(z, 5), round(r, 5) FROM f WHERE nx IS NULL"""),
    "contour_nearest": (contour_nearest, f"WITH {TREE}, {POLYLINES}, p AS (SELECT line % 101 AS contour, x, y, z FROM polylines), c AS (SELECT contour, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY 1), r AS (SELECT contour, cx, cy, cz, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) AS radius FROM p JOIN c USING (contour) GROUP BY ALL), m AS (SELECT t.node_id AS target_id, contour, r.radius AS radius, sqrt((t.x / 100 - cx) ** 2 + (t.y - cy) ** 2 + (t.z - cz) ** 2) AS far FROM tree t, r) SELECT target_id, arg_min(contour, far) AS node_id, round(min(far), 5) AS distance, round(arg_min(radius, far), 5) AS radius FROM m GROUP BY 1"),
    "neurite_trees": (neurite_trees, f"WITH RECURSIVE {NODES}, p AS (SELECT *, max(place) OVER (PARTITION BY lower) - place AS p FROM held) SELECT p.lower, p + 1 AS node_id, CASE WHEN p = 0 THEN -1 ELSE p END AS parent_id, p.node_id AS old_id, node_type, round(x, 6) AS x, radius FROM p JOIN tree ON tree.node_id = p.node_id"),
    "neurite_directions": (neurite_directions, f"WITH RECURSIVE {NEURITES}, b AS (SELECT lower, upper, l.kind AS lk, u.kind AS uk FROM neurites JOIN topo l ON l.node_id = lower JOIN topo u ON u.node_id = upper), w AS (SELECT upper AS src, lower AS dst, uk AS s, lk AS t FROM b UNION ALL SELECT lower, upper, lk, uk FROM b) SELECT src, dst, least(src, dst) AS low, greatest(src, dst) AS high, s = 'soma' AS stem, s = 'soma' AND t = 'soma' AS unresolvable FROM w WHERE s <> 'leaf'"),
    "distribution_keys": (distribution_keys, "SELECT c_custkey AS id, CAST(coalesce(CASE c_nationkey WHEN 1 THEN 0.8 WHEN 3 THEN 0.9 END, CASE c_mktsegment WHEN 'MACHINERY' THEN 1.0 WHEN 'AUTOMOBILE' THEN 0.7 END, CASE WHEN c_custkey % 2 = 0 THEN 1.1 END) AS DOUBLE) AS mean, CAST(coalesce(CASE c_nationkey WHEN 1 THEN 0.5 WHEN 3 THEN 0.6 END, CASE c_mktsegment WHEN 'MACHINERY' THEN 0.4 WHEN 'AUTOMOBILE' THEN 0.3 END, CASE WHEN c_custkey % 2 = 0 THEN 0.7 END) AS DOUBLE) AS std FROM customer"),
    "gcut_roads": (gcut_roads, f"WITH RECURSIVE {ROADS} SELECT lower, upper, m.unit, CASE WHEN free THEN 'freeway' ELSE 'ramp' END AS road, CASE WHEN NOT free THEN CASE WHEN o.node_id IS NOT NULL THEN tops.entry ELSE coalesce(crown, tops.entry) END END AS ramp FROM m LEFT JOIN tops ON tops.e = lower LEFT JOIN (SELECT m.lower AS l, m.upper AS u, unit FROM m) x ON x.l = tops.entry LEFT JOIN on_ o ON o.node_id = x.u AND o.unit = m.unit LEFT JOIN crown ON crown.unit = m.unit"),
    "gcut_decisions": (gcut_decisions, f"WITH RECURSIVE {ROADS}, w AS (SELECT m.lower, m.unit, CASE WHEN free THEN 'freeway' ELSE 'ramp' END AS road, CASE WHEN free THEN m.lower WHEN o.node_id IS NOT NULL THEN tops.entry ELSE coalesce(crown, tops.entry) END AS neurite, n_inner + 1 AS cost FROM m JOIN neurites ne ON ne.lower = m.lower LEFT JOIN tops ON tops.e = m.lower LEFT JOIN (SELECT lower AS l, upper AS u FROM m) x ON x.l = tops.entry LEFT JOIN on_ o ON o.node_id = x.u AND o.unit = m.unit LEFT JOIN crown ON crown.unit = m.unit) SELECT unit, neurite, road, count(*) AS neurites, CAST(sum(cost) AS BIGINT) AS cost FROM w GROUP BY 1, 2, 3"),
    "trace_sources": (trace_sources, f"WITH {VOXELS}, half AS (SELECT z, y // 2 AS y, x // 2 AS x, max(v) AS v FROM voxels GROUP BY 1, 2, 3), k AS (SELECT o_orderkey AS id, CAST(floor(o_orderkey % 9 + 0.75) AS BIGINT) AS lz, CAST(floor((o_custkey % 68 - 2 + 0.25) / 2) AS BIGINT) AS ly, CAST(floor((o_orderkey % 70 - 3 + 0.5) / 2) AS BIGINT) AS lx FROM orders) SELECT id, lz, ly, lx, v IS NOT NULL AS usable FROM k LEFT JOIN half h ON h.z = lz AND h.y = ly AND h.x = lx AND v >= 4"),
    "soma_crops": (soma_crops, f"""WITH RECURSIVE {POINTS}, near AS MATERIALIZED (SELECT a.id AS u, b.id AS w FROM points a JOIN points b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 9.0),
        l(id, label) USING KEY (id) AS (SELECT id, id FROM points UNION SELECT n.u, min(x.label) FROM l x JOIN near n ON n.w = x.id JOIN recurring.l c ON c.id = n.u WHERE x.label < c.label GROUP BY n.u),
        b AS (SELECT label, {", ".join(f"min({a}) - 2 AS {a}min, max({a}) + 2 AS {a}max" for a in "zyx")} FROM points JOIN l USING (id) GROUP BY 1)
        SELECT label, EXISTS (SELECT 1 FROM b o WHERE o.label < b.label AND {" AND ".join(f"b.{a}min < o.{a}max AND o.{a}min < b.{a}max" for a in "zyx")}) AS overlaps, {", ".join(f"round({a}{e}, 5) AS {a}{e}" for a in "zyx" for e in ("min", "max"))} FROM b"""),
    "gcut_neurons": (gcut_neurons, f"""WITH RECURSIVE {PLACED}, least_ AS (SELECT unit, min(soma) AS soma FROM members GROUP BY 1), given AS (SELECT lower, soma FROM placed JOIN least_ USING (unit)),
        chain AS (SELECT lower, pos AS upper_, inner_, lag(pos) OVER (PARTITION BY lower ORDER BY inner_) AS before_ FROM walk),
        strands AS (SELECT soma, coalesce(before_, c.lower) AS u, upper_ AS v FROM chain c JOIN given USING (lower)), ways AS (SELECT soma, u, v FROM strands UNION ALL SELECT soma, v, u FROM strands),
        reach_(soma, node_id, parent_id) AS (SELECT DISTINCT soma, soma, CAST(-1 AS BIGINT) FROM given UNION ALL SELECT r.soma, w.v, r.node_id FROM reach_ r JOIN ways w ON w.soma = r.soma AND w.u = r.node_id AND w.v <> r.parent_id)
        SELECT soma, node_id, parent_id FROM reach_"""),
    "tree_depth_first": (tree_depth_first, f"""WITH RECURSIVE {TREE}, s AS (SELECT node_id, parent_id, floor(x / 5000) AS x, y % 2 AS y, z % 2 AS z FROM tree), gone AS (SELECT a.node_id FROM s a JOIN s b ON b.node_id = a.parent_id AND a.x = b.x AND a.y = b.y AND a.z = b.z),
        up(node_id, pos) AS (SELECT node_id, parent_id FROM s WHERE node_id NOT IN (SELECT node_id FROM gone) UNION ALL SELECT up.node_id, s.parent_id FROM up JOIN s ON s.node_id = up.pos WHERE up.pos IN (SELECT node_id FROM gone)),
        k AS (SELECT node_id, pos AS parent_id FROM up WHERE pos = -1 OR pos NOT IN (SELECT node_id FROM gone)), w(node_id, path) AS (SELECT node_id, [node_id] FROM k WHERE parent_id = -1 UNION ALL SELECT k.node_id, list_append(w.path, k.node_id) FROM k JOIN w ON k.parent_id = w.node_id),
        n AS (SELECT node_id, row_number() OVER (ORDER BY path) AS n FROM w) SELECT a.n AS node_id, coalesce(b.n, -1) AS parent_id, k.node_id AS old_id FROM k JOIN n a ON a.node_id = k.node_id LEFT JOIN n b ON b.node_id = k.parent_id"""),
    "tree_prune_length": (tree_prune_length, f"WITH RECURSIVE {SEGMENTS}, {ENDS}, l AS (SELECT s.top, sum(sqrt((t.x - p.x) ** 2 + (t.y - p.y) ** 2 + (t.z - p.z) ** 2)) AS len FROM s JOIN tree t ON t.node_id = s.node_id JOIN tree p ON p.node_id = t.parent_id GROUP BY 1), short AS (SELECT top FROM l WHERE len < 2500 AND top IN (SELECT s.top FROM s JOIN ends ON ends.node_id = s.node_id)) SELECT tree.node_id, tree.parent_id FROM tree JOIN s ON s.node_id = tree.node_id WHERE tree.parent_id = -1 OR s.top NOT IN (SELECT top FROM short)"),
    "tree_add_nodes": (tree_add_nodes, f"WITH {TREE}, m AS (SELECT node_id * 2 AS node_id, node_id * 3 AS parent_id FROM tree WHERE node_id * 2 NOT IN (SELECT node_id FROM tree)) SELECT node_id, parent_id FROM tree UNION ALL SELECT node_id, parent_id FROM m WHERE parent_id IN (SELECT node_id FROM tree UNION SELECT node_id FROM m)"),
    "tree_link_counts": (link_counts, f"WITH {TREE}, kids AS (SELECT parent_id AS node_id, count(*) AS children FROM tree WHERE parent_id <> -1 GROUP BY 1) SELECT coalesce(children, 0) + CASE WHEN parent_id <> -1 THEN 1 ELSE 0 END AS degree, coalesce(children, 0) AS children, count(*) AS nodes FROM tree LEFT JOIN kids USING (node_id) GROUP BY 1, 2"),
    "tree_bifurcations": (tree_bifurcations, f"WITH RECURSIVE {ORDERS} SELECT branch_order, count(*) AS bifurcations FROM o JOIN kids USING (node_id) WHERE children > 1 AND branch_order <= 5 GROUP BY 1"),
    "distance_transform": (distance_transform, "WITH RECURSIVE {} SELECT z, y, x, round(distance, 6) AS distance FROM front LEFT JOIN d ON d.id = address"),
    "auto_soma": (auto_soma, "WITH RECURSIVE {} SELECT z, y, x, round(distance, 6) AS distance FROM front JOIN d ON d.id = address ORDER BY round(distance, 6) DESC, z, y, x LIMIT 1"),
    "path_targets": (path_targets, f"WITH RECURSIVE {PATHS} SELECT address AS id, d.id IS NOT NULL AS reached, round(distance, 6) AS distance FROM front LEFT JOIN d ON d.id = address WHERE (y * 5 + x * 3 + z) % 61 = 0"),
    "tree_to_targets": (tree_to_targets, f"WITH RECURSIVE {PATHS}, t(id) AS (SELECT d.id FROM d JOIN front ON d.id = address WHERE (y * 5 + x * 3 + z) % 61 = 0 UNION SELECT parent FROM t JOIN up ON up.id = t.id) SELECT t.id, parent FROM t LEFT JOIN up ON up.id = t.id"),
}
_AROUND = ", ".join(f"({a}, {b}, {c})" for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0))
TRANSFORM = f"""{FRONT}, {pairs(3, ", abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) AS step")}, around AS (SELECT address, z + dz AS z, y + dy AS y, x + dx AS x, sqrt(abs(dz) + abs(dy) + abs(dx)) AS far FROM front, (VALUES {_AROUND}) s(dz, dy, dx)),
    border AS (SELECT a.address AS id, min(far) AS distance FROM around a ANTI JOIN front f ON f.z = a.z AND f.y = a.y AND f.x = a.x WHERE a.z BETWEEN 0 AND (SELECT max(z) FROM voxels) AND a.y BETWEEN 0 AND 31 AND a.x BETWEEN 0 AND 31 GROUP BY 1),
    d(id, distance) USING KEY (id) AS (SELECT id, distance FROM border UNION SELECT p.w, min(x.distance + sqrt(p.step)) FROM d x JOIN pairs p ON p.u = x.id LEFT JOIN recurring.d c ON c.id = p.w WHERE c.id IS NULL OR x.distance + sqrt(p.step) < c.distance GROUP BY p.w)"""
for _name in ("distance_transform", "auto_soma"):
    QUERIES[_name] = (QUERIES[_name][0], QUERIES[_name][1].format(TRANSFORM))
