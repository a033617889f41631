"""Neurites between somas, branchings and leaves, and how well an angle fits a neuron."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrovox.operators.trees import ROOT, child_counts, leaves, subtree_sum
from dendrovox.plans.components import connected_components
from dendrovox.plans.durable import materialize
from dendrovox.plans.paths import climb


def topology_nodes(tree: DataFrame, somas: DataFrame) -> DataFrame:
    """(node_id, kind): soma before branch before leaf; the root, if none of these, is a leaf."""
    kinds = somas.select("node_id", F.lit("soma").alias("kind"), F.lit(0).alias("o"))
    kinds = kinds.union(child_counts(tree).where("children > 1").select("node_id", F.lit("branch"), F.lit(1)))
    kinds = kinds.union(leaves(tree).select("node_id", F.lit("leaf"), F.lit(2)))
    kinds = kinds.union(tree.where(F.col("parent_id") == ROOT).select("node_id", F.lit("leaf"), F.lit(2)))
    return kinds.groupBy("node_id").agg(F.min(F.struct("o", "kind")).alias("k")).select("node_id", F.col("k.kind").alias("kind"))


def neurites(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lower, upper, n_inner): pairs of topology nodes on one way, and the nodes between them.

    Each topology node climbs from its parent to the next one.
    """
    marked = tree.join(nodes, "node_id", "left")
    starts = marked.where(F.col("kind").isNotNull() & (F.col("parent_id") != ROOT)).select(F.col("node_id").alias("lower"), F.col("parent_id").alias("node_id"))
    up = climb(marked, F.lit(1).cast("long"), F.col("kind").isNotNull() | (F.col("parent_id") == ROOT))
    return starts.join(up, "node_id").select("lower", F.col("top").alias("upper"), F.col("steps").alias("n_inner"))


def units(neurites_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, unit): components of the topology with the somas cut out; a soma belongs to none."""
    plain = nodes.where("kind <> 'soma'").select("node_id")
    inside = neurites_.join(plain.withColumnRenamed("node_id", "lower"), "lower", "left_semi").join(plain.withColumnRenamed("node_id", "upper"), "upper", "left_semi")
    parts = connected_components(inside.select(F.col("lower").alias("u"), F.col("upper").alias("v")))
    return plain.join(parts.withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("unit"))


def somas_of_units(neurites_: DataFrame, nodes: DataFrame, units_: DataFrame) -> DataFrame:
    """(unit, soma): somas that a neurite joins to a unit. Units of one soma need no decision."""
    somas = nodes.where("kind = 'soma'").select(F.col("node_id").alias("soma"))
    both = neurites_.select(F.col("lower").alias("soma"), F.col("upper").alias("node_id")).union(neurites_.select("upper", "lower"))
    return both.join(somas, "soma", "left_semi").join(units_, "node_id").select("unit", "soma").distinct()


def polyline_steps(lines: DataFrame, line: str = "line", seq: str = "seq") -> DataFrame:
    """Each point with the next one's coordinates in ``n_`` columns; the last of a line has none."""
    order = Window.partitionBy(line).orderBy(seq)
    return lines.withColumns({f"n_{a}": F.lead(a).over(order) for a in "xyz"})


def _norm(parts: list[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))


def polyline_lengths(lines: DataFrame, line: str = "line", seq: str = "seq") -> DataFrame:
    step = _norm([F.col(f"n_{a}") - F.col(a) for a in "xyz"])
    return polyline_steps(lines, line, seq).groupBy(line).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("length"), F.count(F.lit(1)).alias("points"), F.avg("radius").alias("mean_radius"))


def fit_angles(lines: DataFrame, sx: Column, sy: Column, sz: Column, line: str = "line", seq: str = "seq", least: float = 1e-10) -> DataFrame:
    """Mean angle between the tangent at a point and the way from the soma at (sx, sy, sz) to it."""
    steps = polyline_steps(lines, line, seq).where("n_x is not null")
    tangent = [F.col(f"n_{a}") - F.col(a) for a in "xyz"]
    away = [F.col(a) - s for a, s in zip("xyz", (sx, sy, sz))]
    cosine = sum((t * p for t, p in zip(tangent, away)), F.lit(0.0)) / ((_norm(tangent) + least) * (_norm(away) + least))
    return steps.groupBy(line).agg(F.avg(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))).alias("angle"))


def polynomial(coefficients: list[float], x: Column) -> Column:
    """Highest power first."""
    total = F.lit(0.0)
    for c in coefficients:
        total = total * x + F.lit(float(c))
    return total


def integral(coefficients: list[float]) -> list[float]:
    n = len(coefficients)
    return [c / (n - i) for i, c in enumerate(coefficients)] + [0.0]


def tail_probability(angle: Column, coefficients: list[float], mean: float, std: float) -> Column:
    """P(X >= angle) of the density given by a polynomial of (x - mean) / std over [0, pi]."""
    whole = integral(coefficients)
    low, high = (0.0 - mean) / std, (math.pi - mean) / std

    def plain(x: float) -> float:
        total = 0.0
        for c in whole:
            total = total * x + c
        return total

    below = (polynomial(whole, (angle - mean) / std) - plain(low)) / (plain(high) - plain(low))
    return 1 - F.least(F.greatest(below, F.lit(0.0)), F.lit(1.0))


def tail_probabilities(angles: np.ndarray, coefficients: list[float], mean: float, std: float) -> np.ndarray:
    """``tail_probability`` of an array."""
    whole = integral(coefficients)
    low, high = np.polyval(whole, (0.0 - mean) / std), np.polyval(whole, (math.pi - mean) / std)
    return 1 - np.clip((np.polyval(whole, (angles - mean) / std) - low) / (high - low), 0.0, 1.0)


def fit_cost(probability: Column, length: Column, order: Column | int = 1) -> Column:
    """(1 - P ln(1 + 1 / order)) ln(1 + length)."""
    o = order if isinstance(order, Column) else F.lit(float(order))
    return (1 - probability * F.log(1 + 1 / o)) * F.log1p(length)


def assign_tree(costs: DataFrame, parents: DataFrame) -> DataFrame:
    """(neurite, soma): least total cost where every neurite follows its parent neurite's soma.

    The constraint w(child) <= w(parent) with weights of one soma adding to 1 makes a whole rooted
    group take one soma, so a group's costs are summed for each soma and the least is taken.
    ``parents`` has (neurite, parent), parent null at the top of a group.
    """
    tops = climb(parents.withColumn("_up", F.coalesce("parent", F.lit(ROOT))), F.lit(1).cast("long"), F.col("parent").isNull(), "neurite", "_up").select("neurite", F.col("top").alias("group"))
    tops = materialize(tops)
    summed = costs.join(tops, "neurite").groupBy("group", "soma").agg(F.sum("cost").alias("cost"))
    best = summed.groupBy("group").agg(F.min(F.struct("cost", "soma")).alias("b"))
    return tops.join(best, "group").select("neurite", F.col("b.soma").alias("soma"))


def neurite_nodes(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lower, upper, node_id, at): every node of every neurite; ``at`` counts from 0 at the lower end.

    A node between two topology nodes has one child, so it climbs down to its neurite's lower end.
    """
    ends = neurites(tree, nodes)
    only = tree.where(F.col("parent_id") != ROOT).groupBy(F.col("parent_id").alias("node_id")).agg(F.min("node_id").alias("child_id"))
    inner = tree.select("node_id").join(only, "node_id", "left").join(nodes, "node_id", "left")
    down = climb(inner, F.lit(1).cast("long"), F.col("kind").isNotNull() | F.col("child_id").isNull(), "node_id", "child_id").where("steps > 0")
    held = down.select("node_id", F.col("top").alias("lower"), F.col("steps").alias("at")).join(ends.select("lower", "upper"), "lower")
    own = ends.select("lower", "upper", F.col("lower").alias("node_id"), F.lit(0).cast("long").alias("at"))
    last = ends.select("lower", "upper", F.col("upper").alias("node_id"), (F.col("n_inner") + 1).alias("at"))
    return held.select("lower", "upper", "node_id", "at").unionByName(own).unionByName(last)


def neurite_lines(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """One tree a neurite, from its upper end down: (lower, node_id, ..., parent_id) with ids counted in the neurite."""
    held = neurite_nodes(tree, nodes).join(tree.drop("parent_id").withColumnRenamed("node_id", "_old"), F.col("node_id") == F.col("_old")).drop("_old")
    last = Window.partitionBy("lower")
    place = F.max("at").over(last) - F.col("at")
    return held.withColumns({"old_id": F.col("node_id"), "_p": place}).select("lower", (F.col("_p") + 1).alias("node_id"), "node_type", "x", "y", "z", "radius", F.when(F.col("_p") == 0, ROOT).otherwise(F.col("_p")).cast("long").alias("parent_id"), "old_id")


def directed(neurites_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, low, high, stem, unresolvable): ways along neurites. Neurites to a leaf lead there only, others both ways."""
    kinds = nodes.select("node_id", "kind")
    both = neurites_.join(kinds.withColumnsRenamed({"node_id": "lower", "kind": "_l"}), "lower").join(kinds.withColumnsRenamed({"node_id": "upper", "kind": "_u"}), "upper")
    down = both.select(F.col("upper").alias("src"), F.col("lower").alias("dst"), F.col("_u").alias("_s"), F.col("_l").alias("_d"))
    ways = down.union(both.select("lower", "upper", "_l", "_u")).where("_s <> 'leaf'")
    return ways.select("src", "dst", F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"), (F.col("_s") == "soma").alias("stem"), ((F.col("_s") == "soma") & (F.col("_d") == "soma")).alias("unresolvable"))


def distribution_for(table: dict[str, tuple[float, float]], *names: Column) -> Column:
    """Struct (mean, std) of the first of ``names`` (region, species, cell type) that ``table`` knows; else null."""
    known = F.create_map(*[x for k, (mean, std) in table.items() for x in (F.lit(k), F.struct(F.lit(float(mean)).alias("mean"), F.lit(float(std)).alias("std")))])
    return F.coalesce(*[F.try_element_at(known, n) for n in names])


def neurite_units(neurites_: DataFrame, nodes: DataFrame, units_: DataFrame) -> DataFrame:
    """``neurites_`` with the unit of the end that is no soma; between two somas there is none."""
    plain = units_.select(F.col("node_id").alias("lower"), F.col("unit").alias("_lower"))
    upper = units_.select(F.col("node_id").alias("upper"), F.col("unit").alias("_upper"))
    return neurites_.join(plain, "lower", "left").join(upper, "upper", "left").withColumn("unit", F.coalesce("_lower", "_upper")).drop("_lower", "_upper")


def shared_neurites(neurites_: DataFrame, nodes: DataFrame, units_: DataFrame) -> DataFrame:
    """``neurites_`` of units of two and more somas, with their unit and how many these are."""
    totals = somas_of_units(neurites_, nodes, units_).groupBy("unit").agg(F.count(F.lit(1)).alias("somas")).where("somas > 1")
    return neurite_units(neurites_, nodes, units_).where("unit is not null").join(totals, "unit")


def roads(neurites_: DataFrame, nodes: DataFrame, units_: DataFrame) -> DataFrame:
    """(lower, upper, unit, road, ramp): 'freeway' between two somas of a unit, else 'ramp'; ramp: the neurite it hangs on.

    A neurite lies between two somas of its unit exactly if some, but not all of them are below it.
    The others hang on the freeway by one neurite each: the highest below it, or the lowest above it.
    Only units of two and more somas have roads.
    """
    placed = materialize(shared_neurites(neurites_, nodes, units_))
    somas = materialize(nodes.where("kind = 'soma'").select("node_id"))
    at_soma = somas.select(F.col("node_id").alias("upper"), F.lit(True).alias("_top"))
    held = placed.join(at_soma, "upper", "left").select(F.col("lower").alias("node_id"), F.when(F.col("_top"), F.lit(ROOT)).otherwise(F.col("upper")).alias("parent_id"))
    rest = held.join(held.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("_known")), "parent_id", "left").select("node_id", F.when(F.col("_known"), F.col("parent_id")).otherwise(ROOT).alias("parent_id"))
    rest = materialize(rest)
    below = subtree_sum(rest, held.select("node_id").join(somas, "node_id", "left_semi").select("node_id", F.lit(1).cast("long").alias("total")))
    marked = materialize(placed.join(below.withColumnRenamed("node_id", "lower"), "lower").withColumn("free", (F.col("total") > 0) & (F.col("total") < F.col("somas"))))
    on = marked.where("free").select(F.col("lower").alias("node_id"), "unit").union(marked.where("free").select("upper", "unit")).distinct().withColumn("_on", F.lit(True))
    # Off the freeway and without somas below: climb to the highest such neurite.
    chain = rest.join(marked.select(F.col("lower").alias("node_id"), "total", "unit", "upper"), "node_id")
    up = chain.select(F.col("node_id").alias("parent_id"), F.col("total").alias("_up"))
    chain = chain.join(up, "parent_id", "left")
    tops = climb(chain.where("total = 0"), F.lit(0).cast("long"), (F.col("parent_id") == ROOT) | F.col("_up").isNull() | (F.col("_up") > 0)).select(F.col("node_id").alias("lower"), F.col("top").alias("_entry"))
    entry = marked.select(F.col("lower").alias("_entry"), F.col("upper").alias("node_id"), "unit").join(on, ["node_id", "unit"], "left").select("_entry", F.coalesce("_on", F.lit(False)).alias("_meets"))
    # Above all somas: the neurite that meets the freeway from above, one a unit at most.
    crown = marked.where("total = somas").join(on.withColumnRenamed("node_id", "lower"), ["lower", "unit"], "left_semi").groupBy("unit").agg(F.min("lower").alias("_crown"))
    out = marked.join(tops, "lower", "left").join(entry, "_entry", "left").join(crown, "unit", "left")
    ramp = F.when(~F.col("free"), F.when(F.col("_meets"), F.col("_entry")).otherwise(F.coalesce("_crown", "_entry")))
    return out.select("lower", "upper", "unit", F.when(F.col("free"), "freeway").otherwise("ramp").alias("road"), ramp.alias("ramp"))


def assembled(tree: DataFrame, nodes: DataFrame, assigned: DataFrame) -> DataFrame:
    """(soma, node_id, parent_id): the neuron of each soma, from the neurites ``assigned`` (lower, soma) to it.

    Nodes keep their parents, but for those on the way from a soma up to the highest node that it can
    reach: there parents turn round, and the soma becomes the root. What the soma cannot reach over
    its own neurites is left out.
    """
    held = neurite_nodes(tree, nodes).join(assigned, "lower")
    links = materialize(held.where("node_id <> upper").select("soma", "node_id").join(tree.select("node_id", "parent_id"), "node_id"))
    key = F.struct("soma", "node_id")
    chain = links.select(key.alias("node_id"), F.struct("soma", F.col("parent_id").alias("node_id")).alias("parent_id"))
    ends = chain.select(F.col("parent_id").alias("node_id")).distinct().join(chain.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(None).cast(chain.schema["parent_id"].dataType).alias("parent_id"))
    walk = materialize(chain.unionByName(ends))
    tops = materialize(climb(walk, F.lit(1).cast("long"), F.col("parent_id").isNull()).select("node_id", "top"))
    somas = assigned.select("soma").distinct().select("soma", F.struct("soma", F.col("soma").alias("node_id")).alias("node_id"))
    home = somas.join(tops, "node_id").select("top", F.col("node_id.soma").alias("soma"))
    mine = materialize(tops.join(home, "top", "left_semi").select("node_id"))
    path = materialize(somas.select("node_id").join(walk, "node_id"))
    found = path.select("node_id")
    jumps = walk.select("node_id", F.col("parent_id").alias("jump"))
    while not jumps.where("jump is not null").isEmpty():
        jumps = materialize(jumps)
        found = materialize(found.union(found.join(jumps.where("jump is not null"), "node_id").select(F.col("jump").alias("node_id"))).distinct())
        above = jumps.select(F.col("node_id").alias("jump"), F.col("jump").alias("_next"))
        jumps = jumps.join(above, "jump", "left").select("node_id", F.col("_next").alias("jump"))
    turned = walk.where("parent_id is not null").join(found, "node_id", "left_semi").select(F.col("parent_id").alias("node_id"), F.col("node_id.node_id").alias("_turned"))
    out = mine.join(walk, "node_id").join(turned, "node_id", "left").join(found.withColumn("_on", F.lit(True)), "node_id", "left")
    parent = F.when(F.col("_turned").isNotNull(), F.col("_turned")).when(F.col("_on"), F.lit(ROOT)).otherwise(F.col("parent_id.node_id"))
    return out.select(F.col("node_id.soma").alias("soma"), F.col("node_id.node_id").alias("node_id"), parent.cast("long").alias("parent_id"))


def resampled_segments(tree: DataFrame, step: float) -> DataFrame:
    """(lower, k, x, y, z, radius): points every ``step`` along each segment from its lower end up, and its upper end last.

    A segment runs between branchings, tips and the root; places between nodes are interpolated.
    """
    nodes = topology_nodes(tree, tree.select("node_id").limit(0))
    held = neurite_nodes(tree, nodes).join(tree.select("node_id", "x", "y", "z", "radius"), "node_id")
    way = Window.partitionBy("lower").orderBy("at")
    held = held.withColumns({f"n_{c}": F.lead(c).over(way) for c in ("x", "y", "z", "radius")})
    held = held.withColumn("_len", _norm([F.col(f"n_{a}") - F.col(a) for a in "xyz"]))
    held = held.withColumn("_from", F.coalesce(F.sum("_len").over(way.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    inner = held.where("n_x is not null").withColumns({"_a": F.ceil(F.round(F.col("_from") / step, 9)), "_b": F.ceil(F.round((F.col("_from") + F.col("_len")) / step, 9)) - 1})
    inner = inner.where("_a <= _b").withColumn("k", F.explode(F.sequence("_a", "_b")))
    t = F.when(F.col("_len") > 0, (F.col("k") * step - F.col("_from")) / F.col("_len")).otherwise(0.0)
    points = inner.select("lower", F.col("k").cast("long").alias("k"), *[(F.col(c) + (F.col(f"n_{c}") - F.col(c)) * t).alias(c) for c in ("x", "y", "z", "radius")])
    ends = held.where("n_x is null").select("lower", F.ceil(F.round(F.col("_from") / step, 9)).cast("long").alias("k"), "x", "y", "z", "radius")
    return points.unionByName(ends)


def smoothed_lines(lines: DataFrame, columns: tuple[str, ...] = ("x", "y", "z"), line: str = "line", seq: str = "seq") -> DataFrame:
    """``lines`` with ``columns`` weighted 1 2 3 2 1 over five neighbouring points, cut at the ends, which stay."""
    order = Window.partitionBy(line).orderBy(seq)
    ends = F.lag(F.lit(1)).over(order).isNull() | F.lead(F.lit(1)).over(order).isNull()
    out = {}
    for c in columns:
        near = [(1.0, F.lag(c, 2).over(order)), (2.0, F.lag(c).over(order)), (3.0, F.col(c)), (2.0, F.lead(c).over(order)), (1.0, F.lead(c, 2).over(order))]
        total = sum((F.lit(k) * F.coalesce(v, F.lit(0.0)) for k, v in near), F.lit(0.0))
        weight = sum((F.when(v.isNotNull(), F.lit(k)).otherwise(0.0) for k, v in near), F.lit(0.0))
        out[c] = F.when(ends, F.col(c)).otherwise(total / weight)
    return lines.withColumns(out)


def contours(points: DataFrame, by: str = "contour") -> DataFrame:
    """Centre and mean distance from it of the points (x, y, z) of each contour."""
    centre = points.groupBy(by).agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"])
    far = _norm([F.col(a) - F.col(f"c{a}") for a in "xyz"])
    return points.join(centre, by).groupBy(by, *[f"c{a}" for a in "xyz"]).agg(F.avg(far).alias("radius"))


def decision_costs(roads_: DataFrame, costs: DataFrame) -> DataFrame:
    """(unit, neurite, road, neurites, cost): what is decided on. A ramp carries the costs (lower, cost) of all that hangs on it."""
    held = roads_.join(costs, "lower").withColumn("neurite", F.coalesce("ramp", "lower"))
    return held.groupBy("unit", "neurite", "road").agg(F.count(F.lit(1)).alias("neurites"), F.sum("cost").alias("cost"))
