"""Distances between reconstructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrovox.operators.trees import edges, length
from dendrovox.plans.durable import materialize, unsent

#: Sides of a cell of the search for near edges, in reaches of the search.
WIDE = 6
#: Edges that every point may meet.
FEW = 256


def segment_distance(p: tuple[str, str, str], a: tuple[str, str, str], b: tuple[str, str, str]) -> Column:
    """Distance of a point to the segment from a to b; beyond an end, to that end."""
    d = [F.col(j) - F.col(i) for i, j in zip(a, b)]
    w = [F.col(i) - F.col(j) for i, j in zip(p, a)]
    dd = sum((x * x for x in d), F.lit(0.0))
    t = F.when(dd > 0, sum((x * y for x, y in zip(d, w)), F.lit(0.0)) / dd).otherwise(0.0)
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(sum(((y - t * x) * (y - t * x) for x, y in zip(d, w)), F.lit(0.0)))


def samples(tree: DataFrame) -> DataFrame:
    """Points along each edge, floor(1 + length + 0.5) of them from the node on."""
    cut = edges(tree).withColumn("_n", F.floor(1.5 + length()).cast("int"))
    cut = cut.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return cut.select("node_id", "k", *[(F.col(a) + (F.col(f"p_{a}") - F.col(a)) * F.col("k") / F.col("_n")).alias(a) for a in "xyz"])


def spacing(tree: DataFrame) -> float:
    """About the distance between neighbouring edges of ``tree``: how far a first search looks."""
    return _spacing(edges(tree))


def _spacing(cut: DataFrame) -> float:
    # Edges in a plane or on a line leave no volume, so it has a thickness of its own.
    extents = F.lit(1.0)
    for a in "xyz":
        extents = extents * (F.coalesce(F.stddev_pop(a), F.lit(0.0)) * 4 + F.avg(length()) / 16 + 1e-6)
    side = cut.agg(F.sqrt(extents / (F.sum(length()) + 1e-6)).alias("side")).first()["side"]
    return max(float(side or 1.0), 1e-3)


def _met(asked: DataFrame, cut: DataFrame, reach: float) -> DataFrame:
    """Distance of each point to the nearest of the edges close by; the nearest of all if at most ``reach``."""
    side = reach * WIDE
    pieces = cut.withColumn("_n", F.greatest(F.lit(1), F.ceil(length() / side).cast("int"))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    for a in "xyz":
        ends = [F.col(a) + (F.col(f"p_{a}") - F.col(a)) * (F.col("_k") + i) / F.col("_n") for i in (0, 1)]
        low, high = F.least(*ends) - reach * 1.001, F.greatest(*ends) + reach * 1.001
        pieces = pieces.withColumn(f"c{a}", F.explode(F.sequence(F.floor(low / side).cast("long"), F.floor(high / side).cast("long"))))
    near = pieces.select("cx", "cy", "cz", *[F.col(a).alias(f"a_{a}") for a in "xyz"], *[F.col(f"p_{a}").alias(f"b_{a}") for a in "xyz"]).distinct()
    asked = asked.withColumns({f"c{a}": F.floor(F.col(a) / side).cast("long") for a in "xyz"})
    far = segment_distance(("x", "y", "z"), ("a_x", "a_y", "a_z"), ("b_x", "b_y", "b_z"))
    # An edge lies in many cells, of which a plan by the size of the edges knows nothing.
    return unsent(asked).join(unsent(near), ["cx", "cy", "cz"]).groupBy("node_id", "k").agg(F.min(far).alias("distance"))


def point_distances(points: DataFrame, tree: DataFrame, cell: float) -> DataFrame:
    """``points`` with their distance to the nearest edge of ``tree``, however far it is.

    Grid cells are ``WIDE`` times as wide as the search reaches. An edge is cut into pieces no longer
    than a cell and put in all cells of their boxes widened by the reach, a point in its own, so points
    meet only edges close by. What a point finds within the reach is final; others look again three times as
    far until all are done. The first reach is ``cell``, or in a tree of more than ``FEW`` edges their
    spacing if that is less, so a point meets about as many edges in a dense tree as in a sparse one.
    ``distance`` is null only where the tree has no edge or the point no place.
    """
    cut = materialize(edges(tree).select(*[c for a in "xyz" for c in (a, f"p_{a}")]).where(" and ".join(f"abs({c}) < double('Infinity')" for a in "xyz" for c in (a, f"p_{a}"))).distinct())
    points = materialize(points)
    left, found = points.where(" and ".join(f"abs({a}) < double('Infinity')" for a in "xyz")).select("node_id", "k", "x", "y", "z"), None
    if cut.isEmpty():
        return points.withColumn("distance", F.lit(None).cast("double"))
    reach = float(cell) if cut.count() <= FEW else min(float(cell), _spacing(cut))
    while not left.isEmpty():
        sure = materialize(_met(left, cut, reach).where(F.col("distance") <= reach))
        found = sure if found is None else found.unionByName(sure)
        left = materialize(left.join(sure, ["node_id", "k"], "left_anti"))
        reach *= 3
    if found is None:
        return points.withColumn("distance", F.lit(None).cast("double"))
    return points.join(unsent(found), ["node_id", "k"], "left")


def directional_distance(a: DataFrame, b: DataFrame, threshold: float, cell: float) -> DataFrame:
    """One row: points of a, those with a distance to b, its sum and max, and the same from ``threshold`` on."""
    found = point_distances(samples(a), b, cell)
    over = F.col("distance") >= threshold
    return found.agg(
        F.count(F.lit(1)).alias("points"), F.count("distance").alias("near"), F.sum("distance").alias("total"), F.max("distance").alias("most"),
        F.sum(F.when(over, F.col("distance"))).alias("over_total"), F.count(F.when(over, 1)).alias("over"),
    )


def spatial_distance(a: DataFrame, b: DataFrame, threshold: float = 2.0, cell: float = 16.0) -> DataFrame:
    """SD, SSD, share over the threshold (means of both directions) and the smaller maximum."""
    both = directional_distance(a, b, threshold, cell).select("*", F.lit("ab").alias("way")).union(directional_distance(b, a, threshold, cell).select("*", F.lit("ba").alias("way")))
    return both.agg(
        F.avg(F.col("total") / F.col("near")).alias("sd"),
        F.avg(F.when(F.col("over") > 0, F.col("over_total") / F.col("over")).otherwise(0.0)).alias("ssd"),
        F.avg(F.col("over") / F.col("near")).alias("ssd_share"),
        F.min("most").alias("most"),
    )
