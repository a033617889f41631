"""Which soma each neurite of a unit belongs to, where several somas share the unit.

A unit's neurites form a tree whose somas are ends, so the way from a soma to a neurite is the only one. What
a neurite costs a soma depends on that way: on the soma's place, the direction in which the way runs through
the neurite and how many neurites it has. A neurite may be a soma's only if the next one on the way to this
soma is, so the neurites of a soma hang together. The least total cost is found exactly, from the ends of the
tree to its top and back, over parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrovox.operators import neurites as nt
from dendrovox.operators import ways as wy
from dendrovox.operators.trees import ROOT, subtree_sum
from dendrovox.plans.durable import materialize, scratch_path
from dendrovox.plans.paths import climb

#: Neurites that one task decides on.
PART = 20_000
#: Costs that one task holds to decide on.
HELD = 1 << 22
#: Neurites that may meet at one branching below it.
MEET = 12


def unit_ways(roads: DataFrame, somas: DataFrame) -> DataFrame:
    """(unit, soma, lower, upper, below, next, order) for each neurite and soma of each unit of ``roads``.

    ``below``: the soma lies below the neurite; ``next``: the neurite after it on the way to the soma,
    null at the soma; ``order``: neurites on that way, from 1. ``roads``: (unit, lower, upper, ...).
    """
    return wy.pairs(*wy.laid_out(roads, somas))


def way_costs(tree: DataFrame, nodes: DataFrame, ways: DataFrame, probability, least: float = 1e-10) -> DataFrame:
    """(unit, soma, lower, cost): what each neurite costs each soma of its unit.

    The angle is the mean, over the neurite's steps away from the soma, of that between the step and the
    way from the soma to its start; ``probability`` makes a column of the angle's.
    """
    points = nt.neurite_nodes(tree, nodes).join(tree.select("node_id", "x", "y", "z"), "node_id")
    step = points.select("lower", "at", *[F.col(a).alias(f"a{a}") for a in "xyz"]).join(points.select("lower", (F.col("at") - 1).alias("at"), *[F.col(a).alias(f"b{a}") for a in "xyz"]), ["lower", "at"])
    place = tree.select(F.col("node_id").alias("soma"), *[F.col(a).alias(f"s{a}") for a in "xyz"])
    met = ways.select("unit", "soma", "lower", "below", "order").join(place, "soma").join(step, "lower")

    def norm(parts: list[Column]) -> Column:
        return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))

    # Away from a soma below a neurite's steps go up, from the lower end on; else they go down.
    start = [F.when(F.col("below"), F.col(f"a{a}")).otherwise(F.col(f"b{a}")) for a in "xyz"]
    go = [F.when(F.col("below"), F.col(f"b{a}") - F.col(f"a{a}")).otherwise(F.col(f"a{a}") - F.col(f"b{a}")) for a in "xyz"]
    away = [p - F.col(f"s{a}") for p, a in zip(start, "xyz")]
    cosine = sum((t * p for t, p in zip(go, away)), F.lit(0.0)) / ((norm(go) + least) * (norm(away) + least))
    angle = F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))
    sums = met.groupBy("unit", "soma", "lower", "order").agg(F.avg(angle).alias("angle"), F.sum(norm(go)).alias("length"))
    return sums.select("unit", "soma", "lower", nt.fit_cost(probability(F.col("angle")), F.col("length"), F.col("order").cast("double")).alias("cost"))


def decision_edges(roads: DataFrame) -> DataFrame:
    """(unit, edge, up) of freeways and ramps; see ``decision_tree``."""
    free = roads.where("road = 'freeway'").select("unit", "lower", "upper")
    ramps = roads.where("road = 'ramp' and ramp = lower").select("unit", "lower", "upper")
    at = free.select("unit", F.col("lower").alias("node"), F.col("lower").alias("up"))
    on = free.select("unit", F.col("lower").alias("node")).union(free.select("unit", "upper")).distinct().withColumn("_on", F.lit(True))
    # A ramp hangs on the freeway by its upper end, but the one above all somas by its lower end.
    hung = ramps.join(on.withColumnRenamed("node", "upper"), ["unit", "upper"], "left").select("unit", F.col("lower").alias("edge"), F.when(F.col("_on"), F.col("upper")).otherwise(F.col("lower")).alias("node"))
    edges = free.select("unit", F.col("lower").alias("edge"), F.col("upper").alias("node")).union(hung)
    return edges.join(at, ["unit", "node"], "left").select("unit", "edge", F.coalesce("up", -2 - F.col("unit")).alias("up"))


def decision_tree(roads: DataFrame, ways: DataFrame, costs: DataFrame) -> DataFrame:
    """(unit, edge, up, somas, costs, below): what is decided on, as a tree below one edge without cost a unit.

    Freeways and ramps are edges, ramps with the costs of all that hangs on them; ``up`` is the edge
    above, that of a unit's top edges is its root: -2 - unit. Arrays follow the unit's somas in order; a
    root has the soma at the unit's top, if there is one, as its only one with below = false.
    """
    summed = roads.withColumn("edge", F.coalesce("ramp", "lower")).select("unit", "lower", "edge").join(costs, ["unit", "lower"]).groupBy("unit", "edge", "soma").agg(F.sum("cost").alias("cost"))
    edges = decision_edges(roads)
    freeway = roads.where("road = 'freeway'").select("unit", F.col("lower").alias("edge"))
    under = ways.where("below").select("unit", F.col("lower").alias("edge"), "soma", "below").join(freeway, ["unit", "edge"], "left_semi")
    lists = summed.join(under, ["unit", "edge", "soma"], "left").groupBy("unit", "edge").agg(F.array_sort(F.collect_list(F.struct("soma", "cost", F.coalesce("below", F.lit(False)).alias("below")))).alias("l"))
    tops = ways.where("next is null and not below").select("unit", F.col("upper").alias("soma")).distinct()
    roots = edges.select("unit").distinct().join(tops, "unit", "left").select("unit", (-2 - F.col("unit")).alias("edge"), F.lit(ROOT).cast("long").alias("up"), F.when(F.col("soma").isNull(), F.array().cast("array<long>")).otherwise(F.array("soma")).alias("somas"), F.array().cast("array<double>").alias("costs"), F.array().cast("array<boolean>").alias("below"))
    return edges.join(lists, ["unit", "edge"]).select("unit", "edge", "up", F.col("l.soma").alias("somas"), F.col("l.cost").alias("costs"), F.col("l.below").alias("below")).unionByName(roots)


class Branching:
    """The neurites that meet below one edge: each has a soma of its own side or takes one that another, or the edge above, has."""

    def __init__(self, values: list[np.ndarray], below: list[np.ndarray]) -> None:
        if len(values) > MEET:
            raise ValueError(f"more than {MEET} neurites meet at one branching")
        self.values, self.below, self.k = values, below, len(values)
        self.own = [np.where(b, v, np.inf) for v, b in zip(values, below)]
        self.taken = [np.where(b, np.inf, v) for v, b in zip(values, below)]
        self.groups: dict[int, tuple[float, int, int]] = {}
        self.parts: dict[int, tuple[float, int]] = {0: (0.0, 0)}

    def _sum(self, members: int) -> np.ndarray | float:
        return sum((self.taken[i] for i in range(self.k) if members >> i & 1), 0.0)

    def group(self, members: int) -> tuple[float, int, int]:
        """(cost, leader, soma): all of ``members`` take the soma that the leader has below it."""
        if members not in self.groups:
            best = (np.inf, -1, -1)
            for i in range(self.k):
                if members >> i & 1:
                    total = self.own[i] + self._sum(members & ~(1 << i))
                    if len(total) and (low := int(total.argmin()), total[low])[1] < best[0]:
                        best = (float(total[low]), i, low)
            self.groups[members] = best
        return self.groups[members]

    def split(self, members: int) -> tuple[float, int]:
        """(cost, a group) of the best division of ``members`` into groups; the least member is in the group given."""
        if members not in self.parts:
            first, best = members & -members, (np.inf, 0)
            rest = members & ~first
            some = rest
            while True:
                group = some | first
                cost = self.group(group)[0]
                if cost < best[0]:
                    cost += self.split(members & ~group)[0]
                    if cost < best[0]:
                        best = (cost, group)
                if not some:
                    break
                some = (some - 1) & rest
            self.parts[members] = best
        return self.parts[members]

    def takers(self, members: int) -> Iterator[int]:
        some = members
        while True:
            yield some
            if not some:
                return
            some = (some - 1) & members

    def cost(self, among: int) -> np.ndarray | float:
        """Least cost of ``among`` for each soma that the edge above, or a neurite outside ``among``, has."""
        best = None
        for takers in self.takers(among):
            total = self._sum(takers) + self.split(among & ~takers)[0]
            best = total if best is None else np.minimum(best, total)
        return best

    def choose(self, among: int, soma: int | None) -> dict[int, int]:
        """The somas of ``among`` that have this cost; without ``soma`` nothing is offered from outside."""
        takers = min(self.takers(among if soma is not None else 0), key=lambda t: (self._sum(t)[soma] if t else 0.0) + self.split(among & ~t)[0])
        out = {i: soma for i in range(self.k) if takers >> i & 1}
        rest = among & ~takers
        while rest:
            _, group = self.split(rest)
            _, _, low = self.group(group)
            out |= {i: low for i in range(self.k) if group >> i & 1}
            rest &= ~group
        return out


class PartSolver:
    """The edges of one part, with what is known of the parts below it; all of it is kept only where ``assign`` is to follow."""

    def __init__(self, edges: list[dict], messages: dict[int, tuple[np.ndarray, np.ndarray, int]], keep: bool = True) -> None:
        self.edges = {e["edge"]: e for e in edges}
        self.values = dict(messages)
        self.kids: dict[int, list[int]] = {}
        for e in edges:
            if e["up"] in self.edges:
                self.kids.setdefault(e["up"], []).append(e["edge"])
        for edge, up in ((e, m[2]) for e, m in messages.items()):
            self.kids.setdefault(up, []).append(edge)
        self.branchings: dict[int, Branching] = {}
        order = [e["edge"] for e in edges if e["up"] not in self.edges]
        for at in order:
            order += [c for c in sorted(self.kids.get(at, [])) if c in self.edges]
        self.order = order
        for at in reversed(order):
            self._solve(at)
            if not keep:
                del self.branchings[at]
                for kid in self.kids[at]:
                    del self.values[kid]

    def _solve(self, at: int) -> None:
        e, kids = self.edges[at], sorted(self.kids.get(at, []))
        own, below = np.asarray(e["costs"], float), np.asarray(e["below"], bool)
        self.kids[at] = kids
        here = self.branchings[at] = Branching([self.values[c][0] for c in kids], [self.values[c][1] for c in kids])
        if e["up"] == ROOT or not kids:
            self.values[at] = own, below
            return
        every = (1 << len(kids)) - 1
        total = np.where(below, np.inf, own + here.cost(every))
        for i in range(len(kids)):
            # The soma below the edge and below neurite i: neurite i has it too.
            mine = here.below[i]
            if mine.any():
                through = own + here.values[i] + here.cost(every & ~(1 << i))
                total = np.where(mine, through, total)
        self.values[at] = total, below

    def assign(self, given: int | None) -> Iterator[tuple[int, int]]:
        """(edge, place of its soma) of all edges below the part's top, which has ``given``, the parts' tops below it included."""
        labels: dict[int, int | None] = {self.order[0]: given}
        for at in self.order:
            here, kids, label = self.branchings[at], self.kids[at], labels[at]
            if not kids:
                continue
            every, fixed = (1 << len(kids)) - 1, {}
            for i in range(len(kids)):
                if label is not None and here.below[i][label] and self.edges[at]["up"] != ROOT:
                    fixed = {i: label}
            chosen = fixed | here.choose(every & ~sum(1 << i for i in fixed), label)
            for i, c in enumerate(kids):
                labels[c] = chosen[i]
                yield c, chosen[i]


def parts_of(edges: DataFrame, part_edges: int) -> DataFrame:
    """(edge, part, level): parts of at most ``part_edges`` of ``edges`` (edge, up) that hang together, named by their top, and how many parts lie above."""
    sizes = subtree_sum(edges.select(F.col("edge").alias("node_id"), F.col("up").alias("parent_id")), edges.select(F.col("edge").alias("node_id"), F.lit(1).cast("long").alias("total")))
    ranks = materialize(sizes.select(F.col("node_id").alias("edge"), F.expr(f"total div {part_edges}").alias("rank")))
    above = edges.select("edge", "up").join(ranks, "edge").join(ranks.select(F.col("edge").alias("up"), F.col("rank").alias("_rank")), "up", "left")
    tops = climb(above, F.lit(0).cast("long"), (F.col("up") == ROOT) | (F.col("rank") != F.col("_rank")), "edge", "up").select("edge", F.col("top").alias("part"))
    held = materialize(edges.select("edge", "up").join(tops, "edge"))
    over = held.where("edge = part").select("part", "up").join(held.select(F.col("edge").alias("up"), F.col("part").alias("above")), "up", "left").select("part", F.coalesce("above", F.lit(ROOT)).alias("above"))
    depth = climb(over, F.lit(1).cast("long"), F.col("above") == ROOT, "part", "above").select("part", F.col("steps").alias("level"))
    return materialize(held.select("edge", "part").join(depth, "part"))


def decide(edges: DataFrame, part_edges: int = PART) -> DataFrame:
    """(unit, edge, soma): the assignment of the least total cost to ``edges`` as ``decision_tree`` gives them; see ``decide_vectors``."""
    edges = materialize(edges)
    lists = materialize(edges.where("size(costs) > 0").groupBy("unit").agg(F.max("somas").alias("all")))
    held = edges.join(parts_of(edges, part_edges), "edge").join(lists, "unit")
    top = F.when((F.col("up") == ROOT) & (F.size("somas") > 0), F.array_position("all", F.get("somas", F.lit(0))) - 1)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [[kind(x).tobytes() for x in batch.column(c).to_pylist()] for c, kind in (("costs", lambda x: np.array(x, float)), ("below", lambda x: np.packbits(np.array(x, bool))))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *(pa.array(x, pa.binary()) for x in vectors)], names=batch.schema.names)

    vectors = held.select("part", "level", "unit", "edge", "up", top.alias("top"), "costs", "below").mapInArrow(packed, wy.VECTORS)
    return decide_vectors(vectors, lists.withColumnRenamed("all", "somas"))


def decide_vectors(vectors: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, edge, soma): the assignment of the least total cost to the edges that ``vectors`` (see ``ways.VECTORS``) tell of.

    Edges lie in parts that hang together (see ``parts_of``). Costs go from part to part upwards and
    decisions downwards, all parts of one level at a time; a part sends one number a soma. Rows of one edge
    are summed. A root's edge has no costs, and as ``top`` the place of the soma on top of its unit.
    Of equally good assignments one is given, always the same.
    """
    spark = vectors.sparkSession
    path = scratch_path(spark, "vectors")
    vectors.write.partitionBy("level").parquet(path)
    held = spark.read.schema(wy.VECTORS).parquet(path)
    where = materialize(held.select("edge", "part", "level").distinct())
    deepest = where.agg(F.max("level")).first()[0]
    if deepest is None:
        return held.select("unit", "edge", F.lit(None).cast("long").alias("soma")).limit(0)
    near_schema = "part long, edge long, up long, total binary, below binary, given long"

    def solver(mine: pa.Table, near: pa.Table, keep: bool) -> PartSolver:
        edges: dict[int, dict] = {}
        for row in mine.select(["unit", "edge", "up", "top", "costs", "below"]).to_pylist():
            costs = np.frombuffer(row["costs"] or b"")
            if (e := edges.get(row["edge"])) is None:
                edges[row["edge"]] = row | {"costs": costs, "below": np.unpackbits(np.frombuffer(row["below"] or b"", np.uint8), count=len(costs)).astype(bool)}
            else:
                e["costs"] = e["costs"] + costs
        known = {m["edge"]: (t := np.frombuffer(m["total"]), np.unpackbits(np.frombuffer(m["below"], np.uint8), count=len(t)).astype(bool), m["up"]) for m in near.to_pylist() if m["edge"] is not None}
        return PartSolver(list(edges.values()), known, keep)

    def climbed(mine: pa.Table, near: pa.Table) -> pa.Table:
        part = solver(mine, near, False)
        top = part.order[0]
        total, under = part.values[top]
        return pa.table({"edge": pa.array([top], pa.int64()), "up": pa.array([part.edges[top]["up"]], pa.int64()), "total": pa.array([total.tobytes()], pa.binary()), "below": pa.array([np.packbits(under).tobytes()], pa.binary())})

    def fallen(mine: pa.Table, near: pa.Table) -> pa.Table:
        if not len(mine):
            return pa.table({c: pa.array([], pa.int64()) for c in ("unit", "edge", "at")})
        part = solver(mine, near, True)
        top = part.edges[part.order[0]]
        given = top["top"] if top["up"] == ROOT else next(g for g in near.column("given").to_pylist() if g is not None)
        found = list(part.assign(given))
        return pa.table({"unit": pa.array([top["unit"]] * len(found), pa.int64()), "edge": pa.array([e for e, _ in found], pa.int64()), "at": pa.array([s for _, s in found], pa.int64())})

    none = spark.createDataFrame([], near_schema)
    messages, into = {int(deepest): none}, where.select(F.col("edge").alias("up"), "part")
    for r in range(int(deepest), 0, -1):
        sent = held.where(F.col("level") == r).groupBy("part").cogroup(messages[r].groupBy("part")).applyInArrow(climbed, "edge long, up long, total binary, below binary")
        messages[r - 1] = materialize(sent.join(into, "up").select("part", "edge", "up", "total", "below", F.lit(None).cast("long").alias("given")))
    labels, given = none.select(F.lit(0).cast("long").alias("unit"), "edge", F.col("given").alias("at")), none
    tops = where.where("edge = part").select("part")
    for r in range(0, int(deepest) + 1):
        near = messages[r].unionByName(given, allowMissingColumns=True)
        found = materialize(held.where(F.col("level") == r).groupBy("part").cogroup(near.groupBy("part")).applyInArrow(fallen, "unit long, edge long, at long"))
        given = found.select(F.col("edge").alias("part"), F.col("at").alias("given")).join(tops, "part", "left_semi")
        labels = labels.union(found)
    names = units.select("unit", F.posexplode("somas").alias("at", "soma"))
    return labels.join(names.withColumn("at", F.col("at").cast("long")), ["unit", "at"]).select("unit", "edge", "soma")


def decide_roads(roads: DataFrame, somas: DataFrame, tree: DataFrame, neurite_nodes: DataFrame, probability, part_edges: int | None = None) -> DataFrame:
    """(unit, edge, soma) as ``decide`` gives it for ``decision_tree``; costs are vectors over a unit's somas from the first, no rows.

    ``probability`` makes an array of one of angles. Parts hold about ``HELD`` costs if ``part_edges`` is not given.
    """
    laid, units = wy.laid_out(roads, somas)
    if part_edges is None:
        most = units.agg(F.max(F.size("somas"))).first()[0] or 1
        part_edges = min(PART, max(16, HELD // most))
    edges = decision_edges(roads)
    # The soma on top of a unit is the last of its somas, the only one without a neurite above.
    tops = units.select("unit", F.when(F.element_at("depths", -1) == 0, F.size("somas") - 1).cast("long").alias("top"))
    roots = edges.select("unit").distinct().select("unit", (-2 - F.col("unit")).alias("edge"), F.lit(ROOT).cast("long").alias("up"))
    edges = materialize(edges.unionByName(roots))
    placed = edges.join(parts_of(edges, part_edges), "edge")
    mine = roads.select("lower", F.coalesce("ramp", "lower").alias("edge"), (F.col("road") == "freeway").alias("free")).join(placed.select("edge", "part", "level", F.col("up").alias("over")), "edge")
    here = wy.with_points(laid.select("unit", "lower", "depth", "first", "held", "above").join(mine, "lower"), tree, neurite_nodes)
    vectors = wy.cost_vectors(here, wy.with_places(units, tree), probability)
    empty = F.lit(None).cast("binary")
    roots = placed.where(F.col("up") == ROOT).join(tops, "unit").select("part", "level", "unit", "edge", "up", "top", empty.alias("costs"), empty.alias("below"))
    return decide_vectors(vectors.unionByName(roots), units)


def assigned_neurites(neurites_: DataFrame, nodes: DataFrame, units_: DataFrame, roads: DataFrame, decided: DataFrame) -> DataFrame:
    """(lower, soma) of all neurites of units with somas: a unit's only soma, or what was decided; ramps pass it on."""
    placed = nt.neurite_units(neurites_, nodes, units_).where("unit is not null").select("lower", "unit")
    lone = nt.somas_of_units(neurites_, nodes, units_).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.min("soma").alias("soma")).where("n = 1").select("unit", "soma")
    chosen = roads.select("unit", "lower", F.coalesce("ramp", "lower").alias("edge")).join(decided, ["unit", "edge"]).select("lower", "soma")
    return placed.join(lone, "unit").select("lower", "soma").union(chosen)
