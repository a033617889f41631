"""Neuron trees as tables (node_id, node_type, x, y, z, radius, parent_id); a root's parent is -1."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrovox.plans.durable import materialize, unsent
from dendrovox.plans.paths import climb

ROOT = -1
#: Nodes that every target may meet in a search for the nearest.
FEW = 256


def roots(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("parent_id") == ROOT)


def excess_roots(trees: DataFrame) -> DataFrame:
    """Trees that break the rule of one root, with their number of roots."""
    counts = trees.groupBy("tree_id").agg(F.sum((F.col("parent_id") == ROOT).cast("long")).alias("roots"))
    return counts.where("roots <> 1")


def child_counts(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("parent_id") != ROOT).groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("children"))


def degrees(tree: DataFrame) -> DataFrame:
    """Nodes with their numbers of children and neighbours."""
    joined = tree.join(child_counts(tree), "node_id", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    return joined.withColumn("degree", F.col("children") + (F.col("parent_id") != ROOT).cast("long"))


def leaves(tree: DataFrame) -> DataFrame:
    """Nodes without children, but for the root."""
    parents = tree.select(F.col("parent_id").alias("node_id")).distinct()
    return tree.where(F.col("parent_id") != ROOT).join(parents, "node_id", "left_anti")


def branch_nodes(tree: DataFrame) -> DataFrame:
    return child_counts(tree).where("children > 1")


def branch_orders(tree: DataFrame) -> DataFrame:
    """0 for the root and its children; elsewhere the parent's, one more below a branching."""
    counted = degrees(tree)
    above = counted.select(F.col("node_id").alias("parent_id"), F.col("parent_id").alias("_up"), F.col("children").alias("_siblings"))
    joined = counted.join(above, "parent_id", "left")
    step = F.when((F.col("parent_id") != ROOT) & (F.col("_up") != ROOT) & (F.col("_siblings") > 1), 1).otherwise(0).cast("long")
    return climb(joined, step, F.col("parent_id") == ROOT).select("node_id", F.col("total").alias("branch_order"))


def prune_above_order(tree: DataFrame, most: int) -> DataFrame:
    return tree.join(branch_orders(tree).where(F.col("branch_order") <= most).select("node_id"), "node_id", "left_semi")


def segments(tree: DataFrame) -> DataFrame:
    """(node_id, top): the upper end of the unbranched chain that holds the node."""
    counted = degrees(tree)
    above = counted.select(F.col("node_id").alias("parent_id"), F.col("parent_id").alias("_up"), F.col("children").alias("_siblings"))
    joined = counted.join(above, "parent_id", "left")
    starts = (F.col("parent_id") == ROOT) | (F.col("_up") == ROOT) | (F.col("_siblings") > 1) | F.col("_up").isNull()
    return climb(joined, F.lit(1).cast("long"), starts).select("node_id", "top")


def short_tips(tree: DataFrame, least: int) -> DataFrame:
    """Nodes of chains that end in a leaf and have fewer than ``least`` nodes."""
    chains = materialize(segments(tree))
    ended = chains.join(leaves(tree).select("node_id"), "node_id", "left_semi").select("top")
    small = chains.groupBy("top").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)
    return chains.join(ended.join(small, "top", "left_semi"), "top", "left_semi").select("node_id")


def prune_short_tips(tree: DataFrame, least: int, stable: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """Tips of fewer than ``least`` nodes go, again and again until none is left (or ``rounds``).

    Nodes in ``stable`` (node_id) and the root stay, with everything on their tips.
    """
    done = 0
    while rounds is None or done < rounds:
        gone = short_tips(tree, least).join(roots(tree).select("node_id"), "node_id", "left_anti")
        if stable is not None:
            gone = gone.join(stable.select("node_id"), "node_id", "left_anti")
        gone = materialize(gone)
        if gone.isEmpty():
            break
        tree = materialize(tree.join(gone, "node_id", "left_anti"))
        done += 1
    return tree


def standardized(tree: DataFrame, order: str = "node_id") -> DataFrame:
    """Node ids from 1 in the given order, the root first; ``old_id`` keeps the former id."""
    from dendrovox.operators.ranking import ranked

    keyed = tree.withColumn("_g", F.lit(0))
    numbered = ranked(keyed, ["_g"], F.when(F.col("parent_id") == ROOT, F.lit(-1)).otherwise(F.expr(f"{order} div 4096")), [F.col(order)], "_new").drop("_g")
    numbered = numbered.withColumn("_new", F.col("_new") + 1)
    above = numbered.select(F.col("node_id").alias("parent_id"), F.col("_new").alias("_parent"))
    joined = numbered.join(above, "parent_id", "left")
    return joined.select(F.col("_new").alias("node_id"), "node_type", "x", "y", "z", "radius", F.coalesce("_parent", F.lit(ROOT)).alias("parent_id"), F.col("node_id").alias("old_id"))


def offset_ids(tree: DataFrame, by: int) -> DataFrame:
    return tree.withColumns({"node_id": F.col("node_id") + by, "parent_id": F.when(F.col("parent_id") == ROOT, ROOT).otherwise(F.col("parent_id") + by)})


def translated(tree: DataFrame, dx: float = 0, dy: float = 0, dz: float = 0) -> DataFrame:
    return tree.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy, "z": F.col("z") + dz})


def scaled(tree: DataFrame, sx: float = 1, sy: float = 1, sz: float = 1, sr: float = 1) -> DataFrame:
    return tree.withColumns({"x": F.col("x") * sx, "y": F.col("y") * sy, "z": F.col("z") * sz, "radius": F.col("radius") * sr})


def rotated(tree: DataFrame, theta: float) -> DataFrame:
    """Turned in the xy plane by ``theta``."""
    c, s = math.cos(theta), math.sin(theta)
    return tree.withColumns({"x": F.col("x") * c - F.col("y") * s, "y": F.col("x") * s + F.col("y") * c})


def to_whole_volume(tree: DataFrame, level: int, offsets: tuple[float, float, float]) -> DataFrame:
    """Nodes traced in a view at ``level``, in the coordinates of the whole volume at level 0."""
    factor = float(1 << level)
    z, y, x = offsets
    return translated(scaled(tree, factor, factor, 1.0, (factor * factor) ** (1 / 3)), x, y, z)


def root_typed(tree: DataFrame) -> DataFrame:
    return tree.withColumn("node_type", F.when(F.col("parent_id") == ROOT, 1).otherwise(0).cast("long"))


def removed(tree: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the nodes of ``gone`` (node_id); their children hang on the nearest node that stays."""
    marked = tree.join(gone.select("node_id").distinct().withColumn("_gone", F.lit(True)), "node_id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    up = climb(marked, F.lit(0).cast("long"), ~F.col("_gone") | (F.col("parent_id") == ROOT)).select(F.col("node_id").alias("parent_id"), F.col("top").alias("_kept"))
    lost = marked.where("_gone").select(F.col("node_id").alias("_kept"), F.lit(True).alias("_lost"))
    kept = marked.where("not _gone").join(up, "parent_id", "left").join(lost, "_kept", "left")
    parent = F.when(F.col("_lost"), F.lit(ROOT)).otherwise(F.coalesce("_kept", "parent_id"))
    return kept.withColumn("parent_id", parent).select(*tree.columns)


def node_volume(radius: Column) -> Column:
    return F.lit(4 / 3 * math.pi) * F.pow(radius, F.lit(3))


def overlap_volume(d: Column, r: Column, s: Column) -> Column:
    """Volume that two balls share: a lens, the smaller ball, or nothing."""
    lens = F.lit(math.pi) * F.pow(r + s - d, F.lit(2)) * (d * d + 2 * d * (r + s) - 3 * (r - s) * (r - s)) / (12 * d)
    return F.when(d >= r + s, F.lit(0.0)).when(d <= F.abs(r - s), node_volume(F.least(r, s))).otherwise(lens)


def edges(tree: DataFrame) -> DataFrame:
    """Nodes with their parents: columns of the parent have the prefix ``p_``."""
    above = tree.select(F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in ("x", "y", "z", "radius", "parent_id")])
    return tree.join(above, "parent_id")


def length(*axes: str) -> Column:
    return F.sqrt(sum(((F.col(a) - F.col(f"p_{a}")) * (F.col(a) - F.col(f"p_{a}")) for a in (axes or ("x", "y", "z"))), F.lit(0.0)))


def resampled(tree: DataFrame, step: float) -> DataFrame:
    """Points every ``step`` along each edge from the node to its parent: (node_id, k, x, y, z, radius)."""
    cut = edges(tree).withColumn("_len", length()).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("_len") / step).cast("int"))))
    t = F.when(F.col("_len") > 0, F.col("k") * step / F.col("_len")).otherwise(0.0)
    return cut.select("node_id", F.col("k").cast("long").alias("k"), *[(F.col(c) + (F.col(f"p_{c}") - F.col(c)) * t).alias(c) for c in ("x", "y", "z", "radius")])


def morphology(tree: DataFrame) -> DataFrame:
    """One row: length, numbers of nodes, branchings, tips and stems, and the box."""
    counted = degrees(tree).withColumn("_root", F.col("parent_id") == ROOT)
    long = edges(tree).agg(F.coalesce(F.sum(length()), F.lit(0.0)).alias("total_length"))
    counts = counted.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.sum((~F.col("_root") & (F.col("children") > 1)).cast("long")).alias("branches"),
        F.sum((~F.col("_root") & (F.col("children") == 0)).cast("long")).alias("tips"),
        F.sum(F.when(F.col("_root"), F.col("children")).otherwise(0)).alias("stems"),
        *[f(a).alias(f"{a}{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))],
    )
    return counts.join(F.broadcast(long))


def _finite(*columns: str) -> Column:
    test = F.lit(True)
    for c in columns:
        test &= F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) & ~F.isnan(c)
    return test


def nearest_node(tree: DataFrame, targets: DataFrame, cell: float) -> DataFrame:
    """(target_id, node_id, distance) of the node nearest to each target (target_id, x, y, z).

    Nodes lie in cubes of side ``cell``. A target looks in the 27 cubes around its own, and what it
    finds within ``cell`` is final; others look again in cubes twice as wide until all are done, so
    ``cell`` decides the speed only. Up to ``FEW`` nodes, which may lie in one cube that all targets ask,
    are measured by each target where it stands. Equally near nodes: the smaller id. Targets without a place
    (null, NaN or infinite) and all targets of a tree without placed nodes have null results.
    """
    shift = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for v, a in zip(d, "xyz")]) for d in [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]])
    nodes = materialize(tree.select("node_id", *[F.col(a).cast("double").alias(f"n{a}") for a in "xyz"]).where(_finite("nx", "ny", "nz")))
    targets = materialize(targets.select("target_id", *[F.col(a).cast("double").alias(a) for a in "xyz"]))
    nothing = [F.lit(None).cast(tree.schema["node_id"].dataType).alias("node_id"), F.lit(None).cast("double").alias("distance")]
    if nodes.isEmpty():
        return targets.select("target_id", *nothing)
    far = F.sqrt(sum(((F.col(a) - F.col(f"n{a}")) * (F.col(a) - F.col(f"n{a}")) for a in "xyz"), F.lit(0.0)))
    if nodes.count() <= FEW:
        # Two passes of plain minima: one of pairs would sort all that meet.
        placed, every = targets.where(_finite("x", "y", "z")), F.broadcast(nodes)
        least = materialize(placed.crossJoin(every).groupBy("target_id").agg(F.min(far).alias("distance")))
        met = placed.join(unsent(least), "target_id").crossJoin(every).where(far == F.col("distance"))
        best = met.groupBy("target_id", "distance").agg(F.min("node_id").alias("node_id")).select("target_id", "node_id", "distance")
        return targets.where(~_finite("x", "y", "z")).select("target_id", *nothing).unionByName(best)
    found = targets.where(~_finite("x", "y", "z")).select("target_id", *nothing)
    left, side = targets.where(_finite("x", "y", "z")), float(cell)
    while not left.isEmpty():
        cells = [F.floor(F.col(a) / side).alias(f"c{a}") for a in "xyz"]
        held = nodes.select("*", *[F.floor(F.col(f"n{a}") / side).alias(f"c{a}") for a in "xyz"])
        asked = left.select("target_id", "x", "y", "z", *cells).withColumn("_s", F.explode(shift))
        asked = asked.select("target_id", "x", "y", "z", *[(F.col(f"c{a}") + F.col(f"_s.d{a}")).alias(f"c{a}") for a in "xyz"])
        best = asked.join(held, ["cx", "cy", "cz"]).groupBy("target_id").agg(F.min(F.struct(far.alias("distance"), "node_id")).alias("b"))
        sure = materialize(best.where(F.col("b.distance") <= side).select("target_id", F.col("b.node_id").alias("node_id"), F.col("b.distance").alias("distance")))
        found = found.unionByName(sure)
        left = materialize(left.join(sure, "target_id", "left_anti"))
        side *= 2
    return found


def tree_labels(forest: DataFrame) -> DataFrame:
    """(node_id, root) for tables with several roots."""
    return climb(forest, F.lit(0).cast("long"), F.col("parent_id") == ROOT).select("node_id", F.col("top").alias("root"))


def subtree_max(tree: DataFrame, value: DataFrame) -> DataFrame:
    """(node_id, best): the largest ``value`` (node_id, best) at or below each node, where there is one.

    Round i sends what nodes know of the 2^i levels below them to their ancestors 2^i levels up, so
    a chain of n nodes takes log2(n) rounds.
    """
    state = tree.select("node_id", F.when(F.col("parent_id") != ROOT, F.col("parent_id")).alias("jump")).join(value, "node_id", "left")
    state = materialize(state)
    while not state.where("jump is not null").isEmpty():
        sent = state.where("jump is not null and best is not null").groupBy(F.col("jump").alias("node_id")).agg(F.max("best").alias("_sent"))
        above = state.select(F.col("node_id").alias("jump"), F.col("jump").alias("_next"))
        state = state.join(above, "jump", "left").join(sent, "node_id", "left")
        better = F.when(F.col("best").isNull() | (F.col("_sent") > F.col("best")), F.col("_sent")).otherwise(F.col("best"))
        state = materialize(state.select("node_id", F.col("_next").alias("jump"), better.alias("best")))
    return state.where("best is not null").select("node_id", "best")


def hierarchical_segments(tree: DataFrame, weight: str = "radius") -> DataFrame:
    """(node_id, leaf, top, nodes): each node's heaviest leaf below, and the top of that leaf's segment.

    A leaf's weight is the sum of ``weight`` from the root to it; ties go to the larger id. The
    segment of a leaf reaches up to the highest node whose heaviest leaf it is.
    """
    sums = climb(tree, F.col(weight), F.col("parent_id") == ROOT)
    depth = materialize(tree.select("node_id").join(sums.select("node_id", "total", "steps"), "node_id"))
    tips = leaves(tree).select("node_id").join(depth.select("node_id", "total"), "node_id")
    done = subtree_max(tree, tips.select("node_id", F.struct("total", F.col("node_id").alias("leaf")).alias("best")))
    owned = done.join(depth.select("node_id", "steps"), "node_id")
    tops = owned.groupBy(F.col("best.leaf").alias("leaf")).agg(F.min(F.struct("steps", "node_id")).alias("t"), F.count(F.lit(1)).alias("nodes"))
    return owned.select("node_id", F.col("best.leaf").alias("leaf")).join(tops.select("leaf", F.col("t.node_id").alias("top"), "nodes"), "leaf")


def subtree_sum(tree: DataFrame, value: DataFrame) -> DataFrame:
    """(node_id, total): sum of ``value`` (node_id, total) over each node and all below it, in log2(depth) rounds."""
    state = tree.select("node_id", F.when(F.col("parent_id") != ROOT, F.col("parent_id")).alias("jump")).join(value, "node_id", "left")
    state = materialize(state.withColumn("total", F.coalesce("total", F.lit(0))))
    while not state.where("jump is not null").isEmpty():
        sent = state.where("jump is not null").groupBy(F.col("jump").alias("node_id")).agg(F.sum("total").alias("_sent"))
        above = state.select(F.col("node_id").alias("jump"), F.col("jump").alias("_next"))
        state = state.join(above, "jump", "left").join(sent, "node_id", "left")
        state = materialize(state.select("node_id", F.col("_next").alias("jump"), (F.col("total") + F.coalesce("_sent", F.lit(0))).alias("total")))
    return state.select("node_id", "total")


def depth_first(tree: DataFrame) -> DataFrame:
    """(node_id, order): places from 0 in the walk that goes down before it goes on, smaller ids first; roots in order of id.

    A node's place is its parent's, one more, and the sizes of the subtrees of its smaller siblings.
    """
    sizes = subtree_sum(tree, tree.select("node_id", F.lit(1).cast("long").alias("total")))
    before = Window.partitionBy("parent_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    step = tree.select("node_id", "parent_id").join(sizes, "node_id").withColumn("_step", F.coalesce(F.sum("total").over(before), F.lit(0)) + (F.col("parent_id") != ROOT).cast("long"))
    summed = climb(step, F.col("_step"), F.col("parent_id") == ROOT)
    tops = step.where(F.col("parent_id") == ROOT).select(F.col("node_id").alias("top"), F.col("_step").alias("_base"))
    return summed.join(tops, "top").select("node_id", (F.col("total") + F.col("_base")).alias("order"))


def sorted_tree(tree: DataFrame) -> DataFrame:
    """``tree`` renumbered from 1 depth first, without nodes that lie where their parent does; ``old_id`` keeps the former id."""
    same = edges(tree).where(" and ".join(f"{a} = p_{a}" for a in "xyz")).select("node_id")
    tree = materialize(removed(tree, same))
    order = materialize(depth_first(tree))
    own = order.select("node_id", (F.col("order") + 1).alias("_new"))
    up = order.select(F.col("node_id").alias("parent_id"), (F.col("order") + 1).alias("_up"))
    joined = tree.join(own, "node_id").join(up, "parent_id", "left")
    return joined.select(F.col("_new").alias("node_id"), "node_type", "x", "y", "z", "radius", F.coalesce("_up", F.lit(ROOT)).cast("long").alias("parent_id"), F.col("node_id").alias("old_id"))


def prune_by_length(tree: DataFrame, least: float) -> DataFrame:
    """``tree`` without the tips (chains up to the branching or root) that are shorter than ``least``."""
    chains = materialize(segments(tree))
    long = edges(tree).select("node_id", length().alias("_len"))
    sums = chains.join(long, "node_id").groupBy("top").agg(F.sum("_len").alias("_len"))
    ended = chains.join(leaves(tree).select("node_id"), "node_id", "left_semi").select("top")
    short = sums.where(F.col("_len") < least).join(ended, "top", "left_semi").select("top")
    gone = chains.join(short, "top", "left_semi").select("node_id").join(roots(tree).select("node_id"), "node_id", "left_anti")
    return tree.join(gone, "node_id", "left_anti")


def added(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tree`` with ``nodes``; those whose id is there already or whose parent is nowhere stay out."""
    fresh = nodes.join(tree.select("node_id"), "node_id", "left_anti")
    known = tree.select(F.col("node_id").alias("parent_id")).union(fresh.select("node_id")).distinct()
    return tree.unionByName(fresh.join(known, "parent_id", "left_semi").select(*tree.columns))


def degree_counts(tree: DataFrame) -> DataFrame:
    """(degree, children, nodes): tips, branchings and chain nodes by their links."""
    return degrees(tree).groupBy("degree", "children").agg(F.count(F.lit(1)).alias("nodes"))


def bifurcations(tree: DataFrame, most: int) -> DataFrame:
    """(branch_order, bifurcations) of branchings up to order ``most``."""
    held = branch_orders(tree).where(F.col("branch_order") <= most).join(branch_nodes(tree), "node_id")
    return held.groupBy("branch_order").agg(F.count(F.lit(1)).alias("bifurcations"))


def prune_dark(tree: DataFrame, value: str, most: float) -> DataFrame:
    """``tree`` without tips as long as they are dark: a node stays if it, a node below it or the root has more than ``most``."""
    bright = subtree_max(tree, tree.select("node_id", F.col(value).alias("best"))).where(F.col("best") > most).select("node_id")
    return tree.join(bright.union(roots(tree).select("node_id")).distinct(), "node_id", "left_semi")
