"""A Merkle manifest of a table: hash trees by group, proofs of all rows by butterfly exchange.

Leaves are ordered inside their group and cut into aligned blocks of ``fanout ** deep`` leaves. A task
reduces a block to one subtree root; only these roots travel. Blocks then swap roots as in a butterfly:
in round r the ``fanout`` blocks that differ in digit r alone meet, each learns the others' subtree
roots, and all of them hash the ancestor that they share. So every block climbs the whole way itself
and keeps the siblings it meets: no node sends anything back down. A group's blocks are filled up to a
power of the fanout with empty ones, which hash nothing but let each round meet in runs of equal size,
so that no block is asked by more than ``fanout - 1`` others. The groups' roots are the leaves of one
more tree, built the same way.

Where a run holds fewer nodes than the fanout, even one, those are hashed; one leaf alone is its root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrovox.plans.durable import materialize, scratch_path

FANOUT, DEEP = 2, 9
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def stated(value: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(stated, values)), 256)


def tampered(key: Column) -> Column:
    """The rows whose n_chars a tampering changes: 7 divides the checksum of the decimal key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def positioned(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (g, d, leaf, ...) with ``pos``, their place in g by (d, leaf), and ``n``, the leaves of g.

    Rows are dealt by ranges and written once, each with its place in its range; what a range's rows
    have before them in their group is a sum over ranges. ``g`` is not null; null d come first.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, name)
    order = [F.col("g"), F.col("d").asc_nulls_first(), F.col("leaf")]
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("range"), local.alias("line")).write.parquet(path)
    dealt = spark.read.parquet(path)
    counts = dealt.groupBy("g", "range").agg(F.count(F.lit(1)).alias("rows"), F.min("line").alias("first"))
    whole = Window.partitionBy("g")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("g", "range", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    return dealt.join(starts, ["g", "range"]).withColumn("pos", F.col("line") + F.col("shift")).drop("range", "line", "shift")


@dataclass(frozen=True)
class Blocks:
    """How leaves are cut: blocks of ``fanout ** deep``."""

    fanout: int = FANOUT
    deep: int = DEEP

    @property
    def width(self) -> int:
        return self.fanout**self.deep

    def levels(self, hashes: list[str], n: int) -> list[list[str]]:
        """The levels of a block's subtree, leaves first; a group's only block ends at the group's root."""
        out = [hashes]
        while len(out[-1]) > 1 if n <= self.width else len(out) <= self.deep:
            low = out[-1]
            out.append([digest("".join(low[i : i + self.fanout])) for i in range(0, len(low), self.fanout)])
        return out

    def sides(self, levels: list[list[str]], i: int) -> tuple[list[str], list[str]]:
        """What stands left and right of the path of leaf ``i`` in its run, level by level."""
        left, right = [], []
        for level in levels[:-1]:
            run = i - i % self.fanout
            left.append("".join(level[run:i]))
            right.append("".join(level[i + 1 : run + self.fanout]))
            i //= self.fanout
        return left, right


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of each (g, block), as they come sorted."""
    held, at = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != at and held:
                yield held
                held = []
            at = row[:2]
            held.append(row)
    if held:
        yield held


def block_roots(leaves: DataFrame, cut: Blocks) -> DataFrame:
    """(g, block, n, hash) of ``leaves`` (g, n, pos, leaf)."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_block(batches):
            g, block, _, n, _ = rows[0]
            root = cut.levels([r[4] for r in rows], n)[-1][0]
            yield pa.RecordBatch.from_pydict({"g": [g], "block": pa.array([block], pa.int64()), "n": pa.array([n], pa.int64()), "hash": [root]})

    dealt = leaves.select("g", F.expr(f"pos div {cut.width}").alias("block"), "pos", "n", "leaf")
    return dealt.repartition("g", "block").sortWithinPartitions("g", "block", "pos").mapInArrow(reduce, "g string, block long, n long, hash string")


def butterfly(roots: DataFrame, cut: Blocks) -> list[DataFrame]:
    """For each round, (g, block, level, left, right, hash, last) of all blocks: siblings met and the ancestor hashed.

    ``roots``: (g, block, n, hash). Groups of one block take no part; ``last`` marks their last round.
    """
    f = cut.fanout
    state = roots.where(f"n > {cut.width}").withColumn("nodes", F.expr(f"(n - 1) div {cut.width} + 1"))
    most = state.agg(F.max("nodes")).first()[0] or 1
    # f ** rounds of each group by comparing whole numbers: no logarithm's rounding.
    powers = [1]
    while powers[-1] < most:
        powers.append(powers[-1] * f)
    full = F.coalesce(*[F.when(F.col("nodes") <= p, F.lit(p)) for p in powers]).cast("long")
    filled = state.select("g", "nodes", full.alias("full"), "block", "hash", F.explode(F.sequence(F.col("block"), full - 1, F.col("nodes"))).alias("at"))
    state = filled.select("g", "full", F.col("at").alias("block"), F.when(F.col("at") == F.col("block"), F.col("hash")).alias("hash"))
    rounds = []
    for r, span in enumerate(powers[:-1]):
        run = state.groupBy("g", "full", F.expr(f"block div {span * f}").alias("high"), F.expr(f"block % {span}").alias("low")).agg(F.array_sort(F.collect_list(F.struct("block", "hash"))).alias("run"))
        nodes = F.expr("filter(run.hash, h -> h is not null)")
        run = run.withColumn("parent", F.when(F.size(nodes) > 0, F.sha2(F.array_join(nodes, ""), 256))).select("g", "full", "run", "parent", F.posexplode("run").alias("i", "own"))
        side = lambda part: F.array_join(F.expr(f"filter({part}.hash, h -> h is not null)"), "")
        met = run.select(
            "g", "full", F.col("own.block").alias("block"), F.lit(r).alias("level"), side("slice(run, 1, i)").alias("left"), side("slice(run, i + 2, size(run))").alias("right"),
            F.col("parent").alias("hash"), (F.col("full") == span * f).alias("last"), F.col("own.hash").isNotNull().alias("real"),
        )
        met = materialize(met)
        rounds.append(met)
        state = met.where(~F.col("last")).select("g", "full", "block", "hash")
    return rounds


def tree(leaves: DataFrame, cut: Blocks) -> tuple[DataFrame, DataFrame]:
    """((g, root), (g, block, level, left, right) of what stands beside the path above each block)."""
    roots = materialize(block_roots(leaves, cut))
    tops, above = roots.where(f"n <= {cut.width}").select("g", F.col("hash").alias("root")), None
    for met in butterfly(roots, cut):
        tops = tops.union(met.where("last and block = 0").select("g", "hash"))
        part = met.select("g", "block", "level", "left", "right")
        above = part if above is None else above.union(part)
    # Empty blocks have no leaves; what they met goes no further.
    real = roots.select("g", "block")
    none = real.select("g", "block", F.lit(0).alias("level"), F.lit("").alias("left"), F.lit("").alias("right")).limit(0)
    return tops, none if above is None else above.join(real, ["g", "block"], "left_semi")


def paths(leaves: DataFrame, above: DataFrame, cut: Blocks) -> DataFrame:
    """(g, d, leaf, bent, lefts, rights): what stands beside the path of each leaf up to the last level in ``above``.

    ``leaves``: (g, n, pos, d, leaf, bent). A block's rows of ``above`` reach the task before its leaves.
    """
    d_type = leaves.schema["d"].dataType.simpleString()

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_block(batches):
            upper = [r for r in rows if r[2] < 0]
            own = rows[len(upper) :]
            if not own:
                continue
            levels = cut.levels([r[6] for r in own], own[0][4])
            top_left, top_right = [r[6] for r in upper], [r[7] for r in upper]
            lefts, rights = [], []
            for i in range(len(own)):
                left, right = cut.sides(levels, i)
                lefts.append(left + top_left)
                rights.append(right + top_right)
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in own]), pa.array([r[5] for r in own], pa.int64() if d_type == "bigint" else pa.string()), pa.array([r[6] for r in own]), pa.array([r[7] for r in own], pa.string()), pa.array(lefts, strings), pa.array(rights, strings)],
                names=["g", "d", "leaf", "bent", "lefts", "rights"],
            )

    own = leaves.select("g", F.expr(f"pos div {cut.width}").alias("block"), "pos", F.lit(0).alias("level"), "n", "d", "leaf", "bent")
    head = above.select("g", "block", F.lit(-1).cast("long").alias("pos"), "level", F.lit(0).cast("long").alias("n"), F.lit(None).cast(d_type).alias("d"), F.col("left").alias("leaf"), F.col("right").alias("bent"))
    return own.union(head).repartition("g", "block").sortWithinPartitions("g", "block", "pos", "level").mapInArrow(climb, f"g string, d {d_type}, leaf string, bent string, lefts array<string>, rights array<string>")


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf leads to with the given siblings."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def manifest(df: DataFrame, key: str = "doc_id", source: str = "source", group: str = "lang", size: str = "n_chars", text: str = "text", cut: Blocks = Blocks()) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``df``.

    Leaves ascend by ``key`` inside each ``group``, null keys first and rows of one key by their hash, so
    repeated rows have equal leaves and places side by side; groups ascend bytewise, null first. A null
    text is another leaf than an empty one. No rows, no result; other columns are left out.
    """
    k, s, g, n, t = (F.col(f"`{c}`") for c in (key, source, group, size, text))
    k, n = k.cast("long"), n.cast("decimal(20,0)")
    bent = F.when(tampered(k), leaf_hash(k, s, g, n + 1, t))
    named = F.coalesce(F.concat(F.lit("s"), g), F.lit(""))
    rows = df.select(named.alias("g"), k.alias("d"), leaf_hash(k, s, g, n, t).alias("leaf"), bent.alias("bent"))
    leaves = positioned(rows, "merkle-leaves")
    tops, above = tree(leaves, cut)
    tops = materialize(tops)

    # One more tree over the groups' roots; its paths continue those of the groups' leaves.
    crowns = positioned(tops.select(F.lit("").alias("g"), F.col("g").alias("d"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("bent")), "merkle-groups")
    root, over = tree(crowns, cut)
    root = root.first()
    crowned = materialize(paths(crowns, over, cut).select(F.col("d").alias("g"), "lefts", "rights"))
    steps = crowned.select("g", F.posexplode(F.arrays_zip("lefts", "rights")).alias("i", "side")).select("g", (F.col("i") + 1000).alias("level"), F.col("side.lefts").alias("left"), F.col("side.rights").alias("right"))
    blocks = leaves.select("g", F.expr(f"pos div {cut.width}").alias("block")).distinct()
    whole = above.union(blocks.join(steps, "g").select("g", "block", "level", "left", "right"))
    out = paths(leaves, whole, cut).join(tops.withColumnRenamed("root", "subroot"), "g")
    proof = F.array_join(F.transform(F.arrays_zip("lefts", "rights"), lambda s: F.concat(s["lefts"], s["rights"])), "")
    back = folded(F.coalesce("bent", "leaf"), F.col("lefts"), F.col("rights"))
    out = out.select(F.col("d").alias(key), "leaf", "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"), F.sha2(proof, 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
