"""Components of voxels and points, and the blobs and clusters made of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrovox.operators.neighbours import neighbour_pairs, offsets
from dendrovox.operators.views import Triple, address
from dendrovox.plans.components import connected_components, least_heads
from dendrovox.plans.durable import materialize


def _labelled(nodes: DataFrame, parts: DataFrame, node: str) -> DataFrame:
    return nodes.join(parts.withColumnRenamed("node", node).withColumnRenamed("component", "label"), node, "left").withColumn("label", F.coalesce("label", node))


def _least_in_chunk(place: np.ndarray, wide: tuple[int, int, int], at: np.ndarray, steps: list[tuple[int, int, int]]) -> np.ndarray:
    """The least address of each voxel's component inside one chunk.

    ``place``: addresses in the chunk widened by one on every side, so a step is one difference.
    """
    order = np.argsort(place)
    ordered = place[order]
    ends = []
    for dz, dy, dx in steps:
        to = ordered + (dz * wide[1] + dy) * wide[2] + dx
        spot = np.minimum(np.searchsorted(ordered, to), len(ordered) - 1)
        met = np.flatnonzero(ordered[spot] == to)
        ends.append(np.stack([met, spot[met]]))
    a, b = np.concatenate(ends, axis=1)
    head = least_heads(a, b, len(ordered))
    least = np.full(len(ordered), np.iinfo(np.int64).max)
    np.minimum.at(least, head, at[order])
    out = np.empty(len(ordered), np.int64)
    out[order] = least[head]
    return out


CHUNK = (32, 64, 64)


def label_voxels(foreground: DataFrame, dims: Triple, connectivity: int = 26, chunk: Triple = CHUNK) -> DataFrame:
    """``foreground`` (z, y, x, ...) with address and label: the least address of its component.

    Voxels are labelled inside chunks first. Only pairs of voxels in two chunks reach the star
    rounds, so a component inside a chunk costs no shuffle of its own. Repeated voxels keep theirs.
    """
    kept = [c for c in foreground.columns if c not in ("address", "label", "local", "cz", "cy", "cx")]
    cells = [F.expr(f"{a} div {n}").alias(f"c{a}") for a, n in zip("zyx", chunk)]
    nodes = foreground.select(*kept, address(dims).cast("long").alias("address"), *cells)
    steps = offsets(connectivity, forward=True)
    wide = tuple(n + 2 for n in chunk)

    def local(part: pa.Table) -> pa.Table:
        z, y, x = (part.column(c).to_numpy() % n + 1 for c, n in zip("zyx", chunk))
        place, first, again = np.unique((z * wide[1] + y) * wide[2] + x, return_index=True, return_inverse=True)
        least = _least_in_chunk(place, wide, part.column("address").to_numpy()[first], steps)
        return part.append_column("local", pa.array(least[again]))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    inside = materialize(nodes.groupBy("cz", "cy", "cx").applyInArrow(local, f"{types}, local long"))
    sides = F.lit(False)
    for a, n in zip("zyx", chunk):
        sides |= (F.col(a) % n).isin(0, n - 1)
    border = inside.where(sides).select("z", "y", "x", "local", "cz", "cy", "cx")
    pairs = neighbour_pairs(border, connectivity, forward=True, keep=("local", "cz", "cy", "cx"))
    over = pairs.where("cz <> n_cz or cy <> n_cy or cx <> n_cx").select(F.col("local").alias("u"), F.col("n_local").alias("v"))
    return _labelled(inside, connected_components(over), "local").select(*kept, "address", "label")


def label_chunks(foreground: DataFrame, dims: Triple, chunk: Triple, connectivity: int = 26) -> DataFrame:
    """Places, address and label only, with chunks of a given size."""
    return label_voxels(foreground.select("z", "y", "x"), dims, connectivity, chunk)


def label_points(points: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """``points`` (key, x, y, z) with label: the least key reachable over steps of at most ``radius``.

    Points meet only those in the 27 grid cells of that width around them.
    """
    cell = {f"c{a}": F.floor(F.col(a) / radius).cast("long") for a in "xyz"}
    nodes = materialize(points.withColumns(cell))
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for v, a in zip(d, "xyz")]) for d in [(0, 0, 0), *offsets(26, forward=True)]])
    sent = nodes.withColumn("_s", F.explode(steps)).select(F.col(key).alias("u"), *[F.col(a).alias(f"u{a}") for a in "xyz"], *[(F.col(f"c{a}") + F.col(f"_s.d{a}")).alias(f"c{a}") for a in "xyz"])
    met = sent.join(nodes.select(F.col(key).alias("v"), "x", "y", "z", "cx", "cy", "cz"), ["cx", "cy", "cz"]).where("u <> v")
    far = sum(((F.col(f"u{a}") - F.col(a)) * (F.col(f"u{a}") - F.col(a)) for a in "xyz"), F.lit(0.0))
    parts = connected_components(met.where(far <= radius * radius).select("u", "v"))
    return _labelled(points, parts, key)


def blobs(labelled: DataFrame) -> DataFrame:
    """Mass, centre of mass and half-open box of each label."""
    box = [f for a in "zyx" for f in (F.min(a).alias(f"{a}min"), (F.max(a) + 1).alias(f"{a}max"))]
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("mass"), *[F.avg(a).alias(f"c{a}") for a in "zyx"], *box)


def blob_radius(mass: Column) -> Column:
    """Radius of a ball of that many voxels, as soma files state it."""
    return F.pow(0.75 * mass / F.lit(3.141592653589793), F.lit(1 / 3))


def clusters_with_somas(labelled: DataFrame, somas: DataFrame) -> DataFrame:
    """Box and somas (z, y, x, mass) of each cluster that holds a soma's voxel."""
    inside = somas.join(labelled.select("z", "y", "x", "label"), ["z", "y", "x"])
    held = inside.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("z", "y", "x", "mass"))).alias("somas"))
    return blobs(labelled).join(held, "label")


def cluster_lines(clusters: DataFrame) -> DataFrame:
    """One text line a cluster: box, number of somas, then z, y, x and mass of each."""
    box = F.concat_ws(",", *[F.col(f"{a}{e}").cast("string") for a in "zyx" for e in ("min", "max")])
    each = F.array_join(F.transform("somas", lambda s: F.concat_ws(",", *[s[c].cast("string") for c in ("z", "y", "x", "mass")])), ",")
    return clusters.select(F.concat_ws(",", box, F.size("somas").cast("string"), each).alias("value"))


def parse_cluster_lines(lines: DataFrame) -> DataFrame:
    """Boxes and somas of the lines that ``cluster_lines`` writes; comment lines are skipped."""
    numbers = lines.where(~F.col("value").startswith("#")).select(F.transform(F.split("value", ","), lambda t: t.cast("long")).alias("t"))
    names = [f"{a}{e}" for a in "zyx" for e in ("min", "max")]
    somas = F.transform(F.sequence(F.lit(0), F.element_at("t", 7) - 1), lambda i: F.struct(*[F.get("t", (7 + 4 * i + k).cast("int")).alias(c) for k, c in enumerate(("z", "y", "x", "mass"))]))
    return numbers.select(*[F.get("t", F.lit(k)).alias(n) for k, n in enumerate(names)], F.when(F.element_at("t", 7) > 0, somas).otherwise(F.slice(somas, 1, 0)).alias("somas"))
