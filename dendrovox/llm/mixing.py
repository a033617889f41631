"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Rows of a source are numbered in hash order and cut into units. Sources sit at the leaves of a
binary tree, in order of their weights, and every node interleaves its two children as a Pfair
system of two tasks: with p the child's part of the node's weight, unit j of the child is released
at floor(j / p) and due at ceil((j + 1) / p), and the earliest deadline goes first. For two tasks
that fill the node exactly no deadline comes before its release could be served, so the order has a
closed form: a unit's slot is its own number and that of the sibling's units due before it. Nothing
is simulated and no schedule is made in one task.

Deadlines are kept as virtual times. At virtual time v a source with n units of weight w has been
due min(n, w v) of them, so sources that end leave their part to the others with no new epoch, and
the weights enter exactly (as doubles), not rounded to slots of a cycle. A node keeps each child
less than one unit from its part, and a leaf's deviation is less than one unit a level of the tree:
a block is cut into one unit more than there are levels, so every source is less than one block of
``block_rows`` rows from its target at every place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrovox.operators.ranking import ranked
from dendrovox.plans.durable import materialize

#: Hash digits of the key that spread the rows of a source over tasks.
BUCKET_HEX = 3
#: Nodes of a level that are broadcast, in sources below them; larger levels are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Deadlines closer than this share are one, and the first child goes first.
TIE = 1e-10
OUT = ("block", "slot", "place")


def source_key(source: Column) -> Column:
    """A name for each source that is never null: null itself is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _sources(df: DataFrame, weights: dict[str, float] | None, temperature: float) -> DataFrame:
    """(source, rows, w, at): each source's weight and its place in order of weight."""
    counts = df.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        weight: Column = F.pow(F.col("rows").cast("double"), F.lit(float(temperature)))
    elif weights:
        given = df.sparkSession.createDataFrame([("n" if s is None else f"s{s}", float(w)) for s, w in weights.items()], "source string, given double")
        counts = counts.join(given, "source", "left")
        weight = F.coalesce("given", F.lit(1.0))
    else:
        weight = F.lit(1.0)
    return counts.select("source", "rows", weight.alias("w")).withColumn("at", F.row_number().over(Window.orderBy(F.desc("w"), "source")) - 1)


def _nodes(sources: DataFrame, level: int) -> DataFrame:
    """Per node of ``level``: ends of its sources in virtual time, and what is due and active up to each.

    After i ends ``due[i] + rate[i] * v`` units are due at virtual time v; ``turns[i]``: at end i itself.
    """
    node = F.shiftright("at", level).alias("node")
    order = Window.partitionBy("node").orderBy("end", "at")
    later = F.coalesce(F.sum("w").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    steps = sources.select(node, "at", (F.col("n") / F.col("w")).alias("end"), "n", "w").withColumns({
        "due": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "rate": later, "all": F.sum("w").over(Window.partitionBy("node")),
    })
    steps = steps.withColumn("step", F.struct("end", "at", "due", "rate", (F.col("due") + F.col("end") * F.col("rate")).alias("turns")))
    listed = steps.groupBy("node").agg(F.array_sort(F.collect_list("step")).alias("s"), F.max("all").alias("all"))
    return listed.select(
        "node",
        F.transform("s", lambda x: x["end"]).alias("ends"),
        F.transform("s", lambda x: x["turns"]).alias("turns"),
        F.concat(F.array(F.lit(0.0)), F.transform("s", lambda x: x["due"].cast("double"))).alias("due"),
        F.concat(F.array("all"), F.transform("s", lambda x: x["rate"])).alias("rate"),
    )


def _reached(values: str, x: str, most: int) -> str:
    """SQL for how many of the ascending ``values`` are below ``x``, by halving steps."""
    steps = ", ".join(str(1 << b) for b in range(most.bit_length() - 1, -1, -1))
    return f"aggregate(array({steps}), 0, (i, s) -> if(i + s <= size({values}) and {values}[least(i + s, size({values})) - 1] < {x}, i + s, i))"


def scheduled(units: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """``units`` (source, unit, ...) with slot: the place of the unit among all units of all sources.

    ``sources`` has (source, at, n, w). Each level of the tree is one join with a table of nodes.
    """
    small = n_sources <= BROADCAST_SOURCES
    out = units.join(F.broadcast(sources.select("source", "at", "w")) if small else sources.select("source", "at", "w"), "source")
    out = out.withColumns({"slot": F.col("unit"), "time": (F.col("unit") + 1) / F.col("w"), "node": F.col("at")})
    for level in range((n_sources - 1).bit_length() if n_sources else 0):
        most = 1 << level
        beside = _nodes(sources, level).select((F.col("node").bitwiseXOR(1)).alias("node"), "ends", "due", "rate")
        beside = F.broadcast(beside) if small else beside
        out = out.join(beside, "node", "left").withColumn("time_", F.when(F.col("node") % 2 == 0, F.col("time") * (1 - TIE)).otherwise(F.col("time") * (1 + TIE)))
        out = out.withColumn("i", F.expr(f"if(ends is null, 0, {_reached('ends', 'time_', most)})"))
        out = out.withColumn("slot", F.expr("slot + coalesce(cast(floor(due[i] + rate[i] * time_) as bigint), 0)"))
        out = out.withColumn("node", F.shiftright("node", 1)).drop("ends", "due", "rate", "i", "time_")
        above = _nodes(sources, level + 1).select("node", "ends", "turns", "due", "rate")
        out = out.join(F.broadcast(above) if small else above, "node")
        # The time at which the node's own fluid has served slot + 1 units.
        out = out.withColumn("i", F.expr(_reached("turns", "(slot + 1 - 1e-9)", 2 * most)))
        out = out.withColumn("time", F.expr("if(rate[i] > 0, (slot + 1 - due[i]) / rate[i], ends[size(ends) - 1])")).drop("ends", "turns", "due", "rate", "i")
    return out.drop("node", "time", "at", "w")


def cut(n_sources: int, block_rows: int) -> tuple[int, int]:
    """Rows of a unit and units of a block, from the depth of the tree."""
    levels = (n_sources - 1).bit_length() if n_sources else 0
    return max(1, block_rows // (levels + 1)), levels + 1


def mix(df: DataFrame, weights: dict[str, float] | None = None, block_rows: int = 32, temperature: float = 0.5, source: str = "source", key: str = "doc_id") -> DataFrame:
    """Every row of ``df`` with block (of its source), slot (of its unit) and place: its order in the mixture.

    ``weights`` maps sources to target weights above 0 (sources it lacks: 1); None takes row counts
    to the power ``temperature``. In front of every place each source has less than ``block_rows``
    rows more or less than its target; sources that end leave their part to the others. A null
    source is a source of its own, rows of a null key come by their hash as others do, repeated rows
    are all kept, texts take no part, an empty table stays empty. Columns named block, slot or place
    are replaced; any other name is free.
    """
    if weights and min(weights.values()) <= 0:
        raise ValueError("a target weight must be above 0")
    kept = [c for c in df.columns if c not in OUT or c in (source, key)]
    name = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    base = df.select(source_key(F.col(f"`{source}`")).alias("source"), name.alias("hash"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    counts = materialize(_sources(base, weights, temperature))
    n_sources = counts.count()
    unit_rows, units_a_block = cut(n_sources, block_rows)
    sources = materialize(counts.select("source", "at", "w", F.expr(f"(rows + {unit_rows - 1}) div {unit_rows}").alias("n")))
    units = sources.select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("unit"))
    slots = materialize(scheduled(units, sources, n_sources))

    rows = ranked(base, ["source"], F.substring("hash", 1, BUCKET_HEX), [F.col("hash"), F.col(f"row.`{key}`")], "rank")
    rows = rows.withColumn("unit", F.expr(f"rank div {unit_rows}")).join(slots, ["source", "unit"])
    return rows.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept],
        F.expr(f"rank div {unit_rows * units_a_block}").alias("block"), F.col("slot"), (F.col("slot") * unit_rows + F.expr(f"rank % {unit_rows}")).alias("place"),
    )
