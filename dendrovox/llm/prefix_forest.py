"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives every vector a string of ``BITS`` bits, the sides of random hyperplanes set at the
medians of a bounded sample, and holds the strings as sorted arrays, cut into segments of bounded
size. The arrays hold ids and a code of one byte a component, no vectors. A query goes down to its
own string and comes up again in all trees at once: the prefix shortens level by level until the
trees together hold as many rows as the sample says are needed for ``RECALL``. Counts of all prefixes
of ``CELL_BITS`` bits (at most ``TREES << CELL_BITS`` of them) tell that level without a look at the
arrays. Of the rows below a query's prefix those of the closest codes survive; only their vectors are
fetched and measured exactly, a fixed number for each query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrovox.plans.durable import materialize

TREES, BITS, CELL_BITS = 32, 24, 9
#: Bound of the sample that the hyperplanes' medians and the depth of search are fitted on.
SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 256
RECALL = 0.95
SEGMENT_ROWS = 8192
#: Closest codes that a segment sends on for a query, and those of all segments that are measured, a neighbour.
SEGMENT_KEEP, KEEP = 4, 8
BROADCAST_BYTES = 64 << 20
SEED = 7


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass(frozen=True)
class Hashes:
    planes: np.ndarray
    medians: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> Hashes:
        planes = np.random.default_rng(seed).normal(size=(sample.shape[1], trees * bits))
        return cls(planes, np.median(sample @ planes, axis=0))

    def strings(self, vectors: np.ndarray, bits: int = BITS) -> np.ndarray:
        """The bit string of each vector in each tree, as a whole number."""
        side = (vectors @ self.planes > self.medians).reshape(len(vectors), -1, bits)
        return side @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))


@dataclass(frozen=True)
class Codes:
    """One byte a component: steps of one size in all components, from the middle of the sample's range."""

    middle: np.ndarray
    step: float

    @classmethod
    def fit(cls, sample: np.ndarray) -> Codes:
        low, high = sample.min(axis=0), sample.max(axis=0)
        return cls(low / 2 + high / 2, float((high / 254 - low / 254).max()) or 1.0)

    def of(self, vectors: np.ndarray) -> pa.Array:
        with np.errstate(over="ignore"):
            steps = np.clip(np.rint((vectors - self.middle) / self.step), -127, 127).astype(np.int8)
        return pa.array([x.tobytes() for x in steps], pa.binary())

    @staticmethod
    def read(column: pa.ChunkedArray, dim: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances row by row; very large or small components neither overflow nor vanish."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        gap = vectors - query
        found = np.sqrt((gap * gap).sum(axis=1))
        top = np.abs(gap).max(axis=1, initial=0.0)
        odd = (~np.isfinite(found) | (found < 1e-150)) & (top > 0) & np.isfinite(top)
        if odd.any():
            part = gap[odd] / top[odd, None]
            found[odd] = top[odd] * np.sqrt((part * part).sum(axis=1))
    return found


def needed_share(hashes: Hashes, sample: np.ndarray, k: int, recall: float = RECALL) -> float:
    """Rows that all trees together hold, as a multiple of all rows, where ``recall`` of the k nearest are met.

    In a larger table the nearest rows are nearer than in the sample, so the share errs upwards.
    """
    strings = hashes.strings(sample)
    rows = len(sample)
    chosen = np.arange(rows) if rows <= SAMPLE_QUERIES else np.random.default_rng(SEED).choice(rows, SAMPLE_QUERIES, replace=False)
    depth, load = [], np.zeros(BITS + 1)
    for q in chosen:
        far = distances(sample[q], sample)
        far[q] = np.inf
        near = np.argsort(far, kind="stable")[: min(k, rows - 1)]
        shared = BITS - np.ceil(np.log2((strings ^ strings[q]) + 1.0)).astype(int)
        depth.append(shared[near].max(axis=1))
        load += np.bincount(shared.ravel(), minlength=BITS + 1)
    depths = np.concatenate(depth) if depth else np.zeros(0, int)
    level = next((x for x in range(BITS, 0, -1) if len(depths) and (depths >= x).mean() >= recall), 0)
    return float(load[level:].sum() / max(1, len(chosen) * rows))


@dataclass(frozen=True)
class Layout:
    """Where the rows of each cell lie: ``count`` segments from ``first``; rows up to each cell."""

    first: np.ndarray
    count: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, segment_rows: int) -> Layout:
        """Cells in order share a segment while it has room; a large cell is dealt to several."""
        first, count = np.zeros_like(sizes), np.ones_like(sizes)
        at, room = -1, 0
        for tree in range(len(sizes)):
            room = 0
            for cell, n in enumerate(sizes[tree].tolist()):
                if n > segment_rows:
                    count[tree, cell] = math.ceil(n / segment_rows)
                    first[tree, cell] = at + 1
                    at += int(count[tree, cell])
                    room = 0
                    continue
                if n > room or at < 0:
                    at, room = at + 1, segment_rows
                first[tree, cell] = at
                room -= n
        return cls(first, count, np.concatenate([np.zeros((len(sizes), 1), np.int64), np.cumsum(sizes, axis=1)], axis=1))

    def level(self, cells: np.ndarray, wanted: float) -> int:
        """The longest prefix at which all trees together have ``wanted`` rows."""
        bits = (self.rows.shape[1] - 1).bit_length() - 1
        trees = np.arange(len(cells))
        for level in range(bits, -1, -1):
            low = cells >> (bits - level) << (bits - level)
            if (self.rows[trees, low + (1 << (bits - level))] - self.rows[trees, low]).sum() >= wanted:
                return level
        return 0


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 1)


def nearest(df: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding", segment_rows: int = SEGMENT_ROWS, segment_keep: int | None = SEGMENT_KEEP, keep: int | None = KEEP, share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose key ``every`` divides.

    A descent goes on until all trees together hold ``share`` of all rows, each tree counted (by itself:
    as the sample's neighbours need); of the rows that it meets the ``segment_keep * k`` closest by code
    in a segment and the ``keep * k`` closest of all are measured, with None all that it meets. With
    ``share=TREES`` and None for both the search is exact.

    Null, zero and non-finite vectors, null keys and vectors of another than the commonest dimension
    (of equally common ones: the smallest) take no part; an empty table gives no rows. Some tree
    always holds k others, if there are as many. Of equal vectors only the k + 1 smallest keys are
    indexed: no other can be among the k nearest. Repeated rows count once; ties go to the smaller
    key. Other columns, whatever their names, are left out.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["d"]
    rows = rows.where(F.size("v") == dim)
    least = F.dense_rank().over(Window.partitionBy("v", F.pmod("id", F.lit(64))).orderBy("id"))
    kept = rows.withColumn("r", least).where(F.col("r") <= k + 1)
    kept = materialize(kept.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1).select("id", "v").dropDuplicates(["id"]))
    total = kept.count()
    part = min(1.0, SAMPLE_ROWS / total)
    sample = kept.where(F.pmod(F.xxhash64(F.lit("forest"), "id"), F.lit(1 << 20)) <= F.lit(round(part * (1 << 20)))).limit(2 * SAMPLE_ROWS)
    vectors = np.array([r["v"] for r in sample.orderBy("id").select("v").collect()])
    fitted = Hashes.fit(vectors)
    wanted = max((needed_share(fitted, vectors, k) if share is None else share) * total, TREES * (k + 1))
    hashes = spark.sparkContext.broadcast(fitted)
    codes = Codes.fit(vectors)

    def cells(batches):
        for batch in batches:
            if batch.num_rows:
                strings = hashes.value.strings(_matrix(batch.column(0)))
                found, n = np.unique(np.arange(TREES)[None, :] << CELL_BITS | strings >> (BITS - CELL_BITS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["cell", "n"])

    counted = kept.select("v").mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(TREES << CELL_BITS, np.int64)
    for r in counted:
        table[r["cell"]] = r["n"]
    layout = spark.sparkContext.broadcast(Layout.of(table.reshape(TREES, -1), segment_rows))

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                place = layout.value
                strings = hashes.value.strings(_matrix(batch.column(1)))
                code = codes.of(_matrix(batch.column(1)))
                ids = batch.column(0).to_numpy()
                spread = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
                for tree in range(TREES):
                    cell = strings[:, tree] >> (BITS - CELL_BITS)
                    segment = place.first[tree, cell] + spread % place.count[tree, cell]
                    yield pa.RecordBatch.from_arrays([pa.array(segment), pa.array(strings[:, tree]), batch.column(0), code], names=["segment", "string", "id", "code"])

    def descend(batches):
        for batch in batches:
            if batch.num_rows:
                place = layout.value
                strings = hashes.value.strings(_matrix(batch.column(1)))
                out = [[], [], [], []]
                for row, string in enumerate(strings):
                    level = place.level(string >> (BITS - CELL_BITS), wanted)
                    low = string >> (BITS - level) << (BITS - level)
                    high = low + (np.int64(1) << (BITS - level))
                    for tree in range(TREES):
                        a, b = low[tree] >> (BITS - CELL_BITS), (high[tree] - 1) >> (BITS - CELL_BITS)
                        segments = np.arange(place.first[tree, a], place.first[tree, b] + place.count[tree, b])
                        for column, value in zip(out, (segments, np.full(len(segments), low[tree]), np.full(len(segments), high[tree]), np.full(len(segments), row)), strict=True):
                            column.append(value)
                segments, low, high, row = (np.concatenate(x) for x in out)
                asks = codes.of(_matrix(batch.column(1))).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(segments), pa.array(low), pa.array(high), batch.column(0).take(pa.array(row)), asks], names=["segment", "low", "high", "id", "code"])

    def search(arrays: pa.Table, queries: pa.Table) -> pa.Table:
        """The rows in the range of each query whose codes are closest to its own."""
        found = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)]]
        if arrays.num_rows and queries.num_rows:
            strings = arrays.column("string").to_numpy()
            order = np.argsort(strings, kind="stable")
            strings, ids, held = strings[order], arrays.column("id").to_numpy()[order], Codes.read(arrays.column("code"), dim)[order]
            norms = (held * held).sum(axis=1)
            ends = (np.searchsorted(strings, queries.column(x).to_numpy()) for x in ("low", "high"))
            for own, a, b, code in zip(queries.column("id").to_pylist(), *ends, Codes.read(queries.column("code"), dim), strict=True):
                if b > a:
                    gap = norms[a:b] - 2 * (held[a:b] @ code) + code @ code
                    near = np.argpartition(gap, segment_keep * k)[: segment_keep * k + 1] if segment_keep is not None and b - a > segment_keep * k + 1 else np.arange(b - a)
                    near = near[ids[a:b][near] != own]
                    for column, value in zip(found, (np.full(len(near), own), ids[a:b][near], gap[near]), strict=True):
                        column.append(value)
        return pa.table({n: pa.array(np.concatenate(x)) for n, x in zip(("query_id", "vec_id", "gap"), found, strict=True)})

    def measure(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(distances(_matrix(batch.column(2)), _matrix(batch.column(3))))], names=["query_id", "vec_id", "score"])

    arrays = kept.mapInArrow(index, "segment long, string long, id long, code binary")
    queries = materialize(rows.where(F.col("id") % every == 0).dropDuplicates(["id"]))
    asked = queries.mapInArrow(descend, "segment long, low long, high long, id long, code binary")
    met = arrays.groupBy("segment").cogroup(asked.groupBy("segment")).applyInArrow(search, "query_id long, vec_id long, gap float")
    met = met.groupBy("query_id", "vec_id").agg(F.min("gap").alias("gap"))
    closest = Window.partitionBy("query_id").orderBy("gap", "vec_id")
    survivors = met.select("query_id", "vec_id") if keep is None else met.withColumn("r", F.row_number().over(closest)).where(F.col("r") <= keep * k).select("query_id", "vec_id")
    asking = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    asking = F.broadcast(asking) if queries.count() * (8 * dim + 64) <= BROADCAST_BYTES else asking
    paired = survivors.join(kept.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(asking, "query_id").select("query_id", "vec_id", "q", "v")
    measured = paired.mapInArrow(measure, "query_id long, vec_id long, score double")
    nearer = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return measured.withColumn("rank", F.row_number().over(nearer)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
