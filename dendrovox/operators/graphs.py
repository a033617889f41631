"""Graphs over voxels and shortest paths in them."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrovox.operators.neighbours import neighbour_links, offsets
from dendrovox.operators.views import Triple, address
from dendrovox.plans.durable import materialize, scratch_path


def voxel_graph(foreground: DataFrame, dims: Triple, connectivity: int = 26) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, value) and directed edges (u, v, cost) of a foreground volume.

    value = exp(10 (1 - v / max)^2); cost = step length * mean value of the two ends.
    """
    top = foreground.agg(F.max("v").alias("_top"))
    dark = 1 - F.col("v") / F.col("_top")
    nodes = foreground.join(F.broadcast(top)).withColumns({"id": address(dims), "value": F.exp(10 * dark * dark)}).drop("_top")
    nodes = materialize(nodes)
    links = neighbour_links(nodes, dims, connectivity, keep=("value",))
    return nodes, links.select("u", "v", (F.sqrt(F.col("axes").cast("double")) * (F.col("value") + F.col("n_value")) / 2).alias("cost"))


#: Edges that one task should hold where the graph gives no parts of its own.
PART_EDGES = 500_000
#: Places of a volume in one part: a part of them without a gap has 13 million edges.
PART_PLACES = 1 << 19


def voxel_part(dims: Triple, chunk: Triple | None = None) -> Callable[[Column], Column]:
    """The chunk of a volume that an address lies in: vertices of one part are relaxed together.

    Without ``chunk`` chunks are at most 64 places wide and high, and as deep as ``PART_PLACES`` allows.
    """
    _, ydim, xdim = dims
    dy, dx = min(64, max(ydim, 1)), min(64, max(xdim, 1))
    dz, dy, dx = chunk or (max(1, PART_PLACES // (dy * dx)), dy, dx)

    def part(at: Column) -> Column:
        z, y, x = F.floor(at / (ydim * xdim)), F.floor(at / xdim) % ydim, at % xdim
        return F.xxhash64(F.floor(z / dz), F.floor(y / dy), F.floor(x / dx))

    return part


_REACHED = "id long, distance double, parent long, own boolean"


def _relaxed(state: pa.Table, edges: pa.Table) -> pa.Table:
    """What is known inside one part once better offers have spread in it, and what it offers to other parts; nothing if no offer is better."""
    known, far, offered = (state.column(c).to_numpy() for c in ("id", "distance", "changed"))
    above, rootless = state.column("parent").fill_null(0).to_numpy(), state.column("parent").is_null().to_numpy()
    start, end, cost, inside = (edges.column(c).to_numpy() for c in ("u", "v", "cost", "inside"))
    order = np.argsort(start, kind="stable")
    start, end, cost, inside = start[order], end[order], cost[order], inside[order]
    nodes = np.unique(np.concatenate([known, start, end[inside]]))
    distance, parent, bare = np.full(len(nodes), np.inf), np.zeros(len(nodes), np.int64), np.ones(len(nodes), bool)
    spots = np.searchsorted(nodes, known)
    held = ~offered
    distance[spots[held]], parent[spots[held]], bare[spots[held]] = far[held], above[held], rootless[held]
    # Of several offers the nearest is written last.
    ranked = np.flatnonzero(offered)[np.lexsort((-above[offered], -far[offered]))]
    ranked = ranked[far[ranked] < distance[spots[ranked]]]
    distance[spots[ranked]], parent[spots[ranked]], bare[spots[ranked]] = far[ranked], above[ranked], rootless[ranked]
    seeds = np.unique(spots[ranked])
    heap = list(zip(distance[seeds].tolist(), seeds.tolist()))
    heapq.heapify(heap)
    firsts, lasts = (np.searchsorted(start, nodes, side).tolist() for side in ("left", "right"))
    to = np.where(inside, np.minimum(np.searchsorted(nodes, end), len(nodes) - 1), -1)
    best, up, offers = distance.tolist(), {}, {}
    while heap:
        d, i = heapq.heappop(heap)
        if d > best[i]:
            continue
        first, last = firsts[i], lasts[i]
        for k, (j, more) in enumerate(zip(to[first:last].tolist(), cost[first:last].tolist()), first):
            new = d + more
            if j < 0:
                other = int(end[k])
                if new < offers.get(other, (math.inf,))[0]:
                    offers[other] = new, i
            elif new < best[j]:
                best[j], up[j] = new, i
                heapq.heappush(heap, (new, j))
    distance = np.asarray(best, np.float64)
    moved = np.fromiter(up.keys(), np.int64, len(up))
    parent[moved], bare[moved] = nodes[np.fromiter(up.values(), np.int64, len(up))], False
    mine = np.flatnonzero(np.isfinite(distance)) if len(seeds) else np.empty(0, np.int64)
    others = sorted(offers)
    ids = [*nodes[mine].tolist(), *others]
    distances = [*distance[mine].tolist(), *(offers[i][0] for i in others)]
    parents = np.concatenate([parent[mine], nodes[[offers[i][1] for i in others]]]) if others else parent[mine]
    none = np.concatenate([bare[mine], np.zeros(len(others), bool)])
    return pa.table({"id": pa.array(ids, pa.int64()), "distance": pa.array(distances, pa.float64()), "parent": pa.array(parents, pa.int64(), mask=none), "own": pa.array([True] * len(mine) + [False] * len(others), pa.bool_())})


def _costed(edges: DataFrame) -> DataFrame:
    """``edges`` as a table of (u, v, cost) without negative costs."""
    edges = materialize(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("cost").cast("double").alias("cost")))
    if not edges.where("cost < 0").isEmpty():
        raise ValueError("negative cost")
    return edges


def _distances(edges: DataFrame, sources: DataFrame, part: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, distance, parent) by ``_costed`` edges; a parent is the last vertex before, on some shortest way.

    Edges lie in one folder a part, and so does what a round finds: a round reads, relaxes and writes
    the parts that have offers and leaves the others alone. The driver sees the names of parts only.
    """
    spark = edges.sparkSession
    if part is None:
        parts = edges.count() // PART_EDGES + 1

        def part(at: Column) -> Column:
            return F.pmod(F.xxhash64(at), F.lit(parts))

    root = scratch_path(spark, "paths")
    dealt = edges.withColumns({"part": part(F.col("u")).cast("long"), "inside": part(F.col("u")) == part(F.col("v"))})
    dealt.repartition("part").write.partitionBy("part").parquet(f"{root}/edges")
    dealt = spark.read.schema(dealt.schema).parquet(f"{root}/edges")
    start = F.col("distance") if "distance" in sources.columns else F.lit(0.0)
    first = sources.select(F.col("id").cast("long").alias("id"), start.cast("double").alias("distance"), F.lit(None).cast("long").alias("parent"), F.lit(False).alias("own"))
    found, number, held = first.where("id is not null and distance is not null"), 0, {}
    while True:
        folder = f"{root}/round-{number}"
        found.withColumn("part", part(F.col("id")).cast("long")).write.partitionBy("own", "part").parquet(folder)
        found = spark.read.schema(f"{_REACHED}, part long").parquet(folder)
        touched = [(r["own"], r["part"]) for r in found.select("own", "part").distinct().collect()]
        held.update({p: f"{folder}/own=true/part={p}" for own, p in touched if own})
        active = [p for own, p in touched if not own]
        if not active:
            break
        asked = found.where("not own").select("id", "distance", "parent", F.lit(True).alias("changed"), "part")
        before = [held[p] for p in active if p in held]
        if before:
            state = spark.read.schema("id long, distance double, parent long").parquet(*before)
            asked = asked.union(state.select("*", F.lit(False).alias("changed"), part(F.col("id")).cast("long").alias("part")))
        tasks = min(4 * len(active), 1000)
        theirs = dealt.where(F.col("part").isin(active)).repartition(tasks, "part").groupBy("part")
        found = asked.repartition(tasks, "part").groupBy("part").cogroup(theirs).applyInArrow(_relaxed, _REACHED)
        number += 1
    if not held:
        return spark.createDataFrame([], "id long, distance double, parent long")
    return spark.read.schema("id long, distance double, parent long").parquet(*held.values())


def shortest_paths(edges: DataFrame, sources: DataFrame, part: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, distance, parent) of every vertex that the sources (id) reach; a source has no parent.

    Sources may bring a ``distance`` of their own to start from. Vertices are dealt to parts by ``part`` of their id (without one, by hash). A round relaxes all
    paths inside the parts that have offers and sends out only what crosses their borders, so rounds end
    with the number of borders on a shortest path, not of its edges. Of several parents on shortest
    ways (to a share of 1e-9) the smallest id is given. Negative costs are refused.
    """
    edges = _costed(edges)
    return _least_parents(_distances(edges, sources, part), edges)


def reached(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, reached, distance) of each target (id); those that no source reaches have no distance."""
    found = paths.select("id", "distance")
    return targets.select("id").distinct().join(found, "id", "left").select("id", F.col("distance").isNotNull().alias("reached"), "distance")


def traced(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """``paths`` of the vertices on the ways from the sources to the targets (id) only: a tree to targets."""
    state = materialize(paths.select("id", "parent"))
    on = materialize(state.join(targets.select("id").distinct(), "id", "left_semi").select("id", "parent"))
    jumps = state.select("id", F.col("parent").alias("jump"))
    found = on.select("id")
    # Round i adds the ancestors 2^i levels above all that are found; jumps double.
    while not jumps.where("jump is not null").isEmpty():
        jumps = materialize(jumps)
        found = materialize(found.union(found.join(jumps.where("jump is not null"), "id").select(F.col("jump").alias("id"))).distinct())
        above = jumps.select(F.col("id").alias("jump"), F.col("jump").alias("_next"))
        jumps = jumps.join(above, "jump", "left").select("id", F.col("_next").alias("jump"))
    return paths.join(found, "id", "left_semi")


def _least_parents(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """``paths`` with the smallest of all equally good parents; one that is no nearer itself is none."""
    far = paths.select(F.col("id").alias("u"), F.col("distance").alias("_u"))
    met = edges.join(far, "u").join(paths.select(F.col("id").alias("v"), F.col("distance").alias("_v")), "v")
    good = met.where((F.col("_u") < F.col("_v")) & (F.col("_u") + F.col("cost") <= F.col("_v") * (1 + 1e-9)))
    least = good.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("_least"))
    return paths.join(least, "id", "left").select("id", "distance", F.coalesce("_least", "parent").alias("parent"))


#: Places around a chunk that its voxels' distances are looked for in.
HALO = 4


def _near_places(voxels: DataFrame, dims: Triple, connectivity: int, chunk: Triple = (32, 64, 64)) -> DataFrame:
    """(id, z, y, x, distance) of ``voxels``: their distance to a place without one, null if it may be farther than ``HALO``.

    A voxel goes to the chunks whose surroundings hold it. A way that leaves a chunk's surroundings has at
    least as many steps as lead out of them, so what is no longer than these is the shortest.
    """
    _, ydim, xdim = dims
    inside = voxels.select(*[F.col(a).cast("long").alias(a) for a in "zyx"]).where(" and ".join(f"{a} >= 0 and {a} < {n}" for a, n in zip("zyx", dims)))
    for a, n, size in zip("zyx", dims, chunk):
        inside = inside.withColumn(f"k{a}", F.explode(F.expr(f"sequence(greatest(0, {a} - {HALO}) div {size}, least({n - 1}, {a} + {HALO}) div {size})")))
    steps = [(d, math.sqrt(sum(map(abs, d)))) for d in offsets(connectivity)]

    def measured(part: pa.Table) -> pa.Table:
        core = np.array([part.column(f"k{a}")[0].as_py() * n for a, n in zip("zyx", chunk)])
        end = np.minimum(core + chunk, dims)
        low, high = np.maximum(core - HALO, 0), np.minimum(end + HALO, dims)
        at = np.stack([part.column(a).to_numpy() for a in "zyx"], 1)
        # One place more on every side, from which no way comes.
        far = np.full(high - low + 2, np.inf)
        own = tuple(slice(1, n + 1) for n in high - low)
        far[own] = 0.0
        far[tuple((at - low + 1).T)] = np.inf
        while True:
            before = far[own].copy()
            for d, length in steps:
                np.minimum(far[own], far[tuple(slice(1 + s, n + 1 + s) for s, n in zip(d, high - low))] + length, out=far[own])
            if np.array_equal(before, far[own]):
                break
        at = np.unique(at[((at >= core) & (at < end)).all(1)], axis=0)
        out = np.minimum(np.where(low > 0, at - low + 1, np.inf), np.where(high < dims, high - at, np.inf)).min(1)
        found = far[tuple((at - low + 1).T)]
        ids = (at[:, 0] * ydim + at[:, 1]) * xdim + at[:, 2]
        return pa.table({"id": ids, **{a: at[:, i] for i, a in enumerate("zyx")}, "distance": pa.array(found, mask=~((found <= out) & np.isfinite(found)))})

    return inside.groupBy("kz", "ky", "kx").applyInArrow(measured, "id long, z long, y long, x long, distance double")


def distance_transform(foreground: DataFrame, dims: Triple, connectivity: int = 26) -> DataFrame:
    """``foreground`` (z, y, x, ...) with distance: the length of the shortest way to a place of the volume without a voxel.

    Ways go by steps to neighbours, each as long as the root of the axes it changes. Null if every
    place holds a voxel. Short distances are found chunk by chunk; the search for the others starts from these.
    """
    nodes = materialize(_near_places(foreground, dims, connectivity))
    far, rest = nodes.where("distance is not null").select("id", "distance"), nodes.where("distance is null").drop("distance")
    if not rest.isEmpty():
        links = neighbour_links(rest, dims, connectivity).select("u", "v", F.sqrt(F.col("axes").cast("double")).alias("cost"))
        steps = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(d, ("dz", "dy", "dx"))], F.lit(float(sum(map(abs, d))) ** 0.5).alias("far")) for d in offsets(connectivity)])
        around = rest.withColumn("_s", F.explode(steps)).select("id", F.col("_s.far").alias("far"), *[(F.col(a) + F.col(f"_s.d{a}")).alias(a) for a in "zyx"])
        for a, n in zip("zyx", dims):
            around = around.where(F.col(a).between(0, n - 1))
        met = around.join(nodes.select("z", "y", "x", "distance", F.lit(True).alias("_voxel")), ["z", "y", "x"], "left")
        offer = F.when(F.col("_voxel").isNull(), F.col("far")).otherwise(F.col("distance") + F.col("far"))
        border = met.groupBy("id").agg(F.min(offer).alias("distance")).where("distance is not null")
        far = far.union(_distances(_costed(links), border, voxel_part(dims)).select("id", "distance"))
    return foreground.withColumn("id", address(dims)).join(far, "id", "left").drop("id")


def soma_seed(transform: DataFrame) -> DataFrame:
    """The place of the largest distance; of several the first in z, y and x."""
    return transform.agg(F.max_by(F.struct("z", "y", "x", "distance"), F.struct("distance", -F.col("z"), -F.col("y"), -F.col("x"))).alias("s")).select("s.*")


def hops(edges: DataFrame, sources: DataFrame, part: Callable[[Column], Column] | None = None) -> DataFrame:
    """Breadth-first levels: (id, hops)."""
    return _distances(_costed(edges.select("u", "v", F.lit(1.0).alias("cost"))), sources, part).select("id", F.col("distance").cast("long").alias("hops"))


def outer_vertices(paths: DataFrame) -> DataFrame:
    """Reached vertices that are no vertex's parent."""
    return paths.join(paths.where("parent is not null").select(F.col("parent").alias("id")).distinct(), "id", "left_anti")


def trapped(edges: DataFrame, sources: DataFrame, traps: DataFrame, part: Callable[[Column], Column] | None = None) -> DataFrame:
    """Levels of a search that enters the traps (id) but goes on from none but its own sources."""
    shut = traps.join(sources, "id", "left_anti").select(F.col("id").alias("u"))
    return hops(edges.join(shut, "u", "left_anti"), sources, part)
