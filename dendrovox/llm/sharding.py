"""Sharding by a weighted hash tree of regions, racks and shards, in DataFrame operations only.

A key descends level by level: at a node every child draws ``-ln(u) / weight`` from a hash of the
key and the child, its weight being the sum below it, and the least draw is taken. Where a weight
grows, only the children on the way to it draw better than before, so rows move from anywhere only
into subtrees whose weight has changed; a child whose weights stay keeps its draws and its rows'
places below. A row costs one draw for each child of the nodes on its way, not one for each shard.

A weight that grows inside the tree also draws rows to that subtree's old shards. A shard that joins a
laid tree ``late`` does not: it competes at the root with a draw of its own weight, rows that it wins are
its, and all others descend as if it were not there. So it takes its fair share from all shards alike and
rows move only into it, however many have joined before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrovox.operators.ranking import ranked

DIGITS = 13
SLOT_BUCKET_HEX = 3
OUT = ("size", "text_crc32", "law", "region", "rack", "shard", "slot", "grown_shard")


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0
    late: bool = False

    def path(self, depth: int) -> tuple[int, ...]:
        return (self.region, self.rack, self.shard)[:depth]


def even_tree(shards: int, per_rack: int = 2, racks_per_region: int = 2, laid: int | None = None) -> list[Leaf]:
    """Shards 0..n-1 of weight 1, filled into racks and regions in order; those from ``laid`` on have joined late."""
    return [Leaf(i // (per_rack * racks_per_region), i // per_rack, i, late=laid is not None and i >= laid) for i in range(shards)]


def _name(path: tuple[int, ...]) -> str:
    return "/".join(map(str, path))


def children(tree: list[Leaf]) -> dict[str, list[tuple[str, tuple[int, ...], float]]]:
    """(name, numbers, weight) of the children of each inner node, by the node's name; the root is '', late leaves hang on it."""
    below: dict[str, dict[str, tuple[tuple[int, ...], float]]] = {}
    for x in tree:
        if x.weight > 0:
            steps = [("", x.path(3))] if x.late else [(_name(x.path(depth - 1)), x.path(depth)) for depth in (1, 2, 3)]
            for node, path in steps:
                held, name = below.setdefault(node, {}), _name(path)
                held[name] = (path if x.late else path[-1:], held.get(name, ((), 0.0))[1] + x.weight)
    return {node: [(name, *held[name]) for name in sorted(held)] for node, held in below.items()}


def draw(key: Column, child: Column, weight: Column) -> Column:
    """A draw from the exponential distribution of rate ``weight``."""
    u = F.conv(F.substring(F.md5(F.concat_ws("/", key, child)), 1, DIGITS), 16, 10).cast("long")
    return -F.log((u.cast("double") + 0.5) / float(16**DIGITS)) / weight


def descend(df: DataFrame, key: Column, tree: list[Leaf], out: str) -> DataFrame:
    """``df`` with ``out``: struct (region, rack, shard) that the key reaches."""
    held = children(tree)
    if not held:
        raise ValueError("no shard has a weight above 0")
    table = F.create_map(*[x for node, parts in held.items() for x in (F.lit(node), F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, numbers)).alias("numbers"), F.lit(float(w)).alias("weight")) for n, numbers, w in parts]))])
    step = F.struct(F.lit("").alias("name"), F.array().cast("array<int>").alias("way"))

    def down(at: Column, _: Column) -> Column:
        best = F.array_min(F.transform(F.element_at(table, at["name"]), lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name"), c["numbers"].alias("numbers"))))
        return F.when(F.size(at["way"]) == 3, at).otherwise(F.struct(best["name"].alias("name"), F.concat(at["way"], best["numbers"]).alias("way")))

    way = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), step, down, lambda at: at["way"])
    return df.withColumn(out, way).withColumn(out, F.struct(*[F.get(out, F.lit(i)).alias(n) for i, n in enumerate(("region", "rack", "shard"))]))


def shard(df: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row: size, text_crc32, law, region, rack, shard, slot and grown_shard are added.

    Law ``key``: only the key and the tree decide. Rows with the same key (a null one included)
    share a shard and get different slots; repeated rows stay. A null text counts no bytes. Slots are
    numbered from 0 in each shard in the order of a hash of the key, so no task holds a shard.
    Columns with the names added are replaced; any other name is free. An empty table stays empty.
    """
    kept = [c for c in df.columns if c not in OUT or c in (key, text)]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")).alias("name"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"))
    base = descend(base, F.col("name"), tree, "at")
    base = descend(base, F.col("name"), grown, "later") if grown else base.withColumn("later", F.struct(F.lit(None).cast("int").alias("shard")))
    base = base.select("row", "size", "text_crc32", F.md5("name").alias("hash"), *[F.col(f"at.{c}").alias(c) for c in ("region", "rack", "shard")], F.col("later.shard").alias("grown_shard"))
    placed = ranked(base, ["shard"], F.substring("hash", 1, SLOT_BUCKET_HEX), [F.col(f"row.`{key}`")], "slot")
    added = {"law": F.lit("key")} | {c: F.col(c) for c in OUT if c != "law"}
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in kept if c not in OUT or c in (key, text)], *[added[c].alias(c) for c in OUT])
