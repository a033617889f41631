"""Centroid clustering over subvector dictionaries.

Vectors are turned into whole numbers and stored once in chunks of at most ``CHUNK_ROWS`` rows. In a
chunk, each block of dimensions is dictionary-encoded without loss: the distinct subvectors of the block
are written once and a row holds one code a block. A round computes the exact squared distance of every
distinct subvector to every centroid's part once and a row's distance is the sum of what its codes say;
a centroid's new sum is the dictionary weighted by how often the cluster has each code. Chunks are read
and never shuffled: what leaves one in a round is a count and a sum for each cluster, what enters it are
the centroids. Dictionaries belong to chunks, so none grows with the table, and all sums are of whole
numbers, so the result does not depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendrovox.plans.durable import materialize, scratch_path

DIMS, BLOCK, SCALE = 64, 2, 64
CLUSTERS, ROUNDS = 16, 3
CHUNK_ROWS = 16_384
#: Largest whole number in a vector: squared distances over 64 dimensions still fit a long.
MOST = 1 << 27


def encode(whole: np.ndarray, block: int = BLOCK) -> tuple[list[bytes], list[bytes]]:
    """(dictionary, codes) of each block of the columns of ``whole`` (int32 rows), as bytes."""
    words, codes = [], []
    for at in range(0, whole.shape[1], block):
        part = np.ascontiguousarray(whole[:, at : at + block])
        distinct, code = np.unique(part, axis=0, return_inverse=True)
        words.append(distinct.astype("<i4").tobytes())
        codes.append(code.reshape(-1).astype("<u2").tobytes())
    return words, codes


class Chunk:
    """One stored chunk: dictionaries and codes of its blocks."""

    def __init__(self, words: list[bytes], codes: list[bytes], dims: int = DIMS, block: int = BLOCK) -> None:
        widths = [min(block, dims - at) for at in range(0, dims, block)]
        self.words = [np.frombuffer(w, "<i4").reshape(-1, n).astype(np.int64) for w, n in zip(words, widths)]
        self.codes = [np.frombuffer(c, "<u2") for c in codes]
        self.starts = [at for at in range(0, dims, block)]

    def decoded(self) -> np.ndarray:
        return np.concatenate([w[c] for w, c in zip(self.words, self.codes)], axis=1)

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid, the smaller number of equally near ones, and squared distance of each row."""
        total = np.zeros((len(self.codes[0]), len(centroids)), np.int64)
        for at, words, codes in zip(self.starts, self.words, self.codes):
            apart = words[:, None, :] - centroids[None, :, at : at + words.shape[1]]
            total += (apart * apart).sum(axis=2)[codes]
        nearest = total.argmin(axis=1)
        return nearest, total[np.arange(len(total)), nearest]

    def sums(self, nearest: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each cluster and their componentwise sum, by the counts of codes."""
        rows = np.bincount(nearest, minlength=clusters)
        parts = []
        for words, codes in zip(self.words, self.codes):
            seen = np.bincount(nearest * len(words) + codes, minlength=clusters * len(words)).reshape(clusters, len(words))
            parts.append(seen @ words)
        return rows, np.concatenate(parts, axis=1)


def store(vectors: DataFrame, path: str, dims: int, block: int, scale: int, chunk_rows: int) -> DataFrame:
    """Chunks (ids, words, codes) of rows (id, v), v an array of ``dims`` whole numbers, written to ``path``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0

        def chunk() -> pa.RecordBatch:
            words, codes = encode(np.concatenate(parts), block)
            listed = pa.chunked_array(ids, pa.int64()).combine_chunks()
            rows = pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed)
            return pa.RecordBatch.from_arrays([rows, pa.array([words], pa.list_(pa.binary())), pa.array([codes], pa.list_(pa.binary()))], names=["ids", "words", "codes"])

        for batch in batches:
            whole = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            at = 0
            while at < len(whole):
                take = min(len(whole) - at, chunk_rows - held)
                ids.append(batch.column(0).slice(at, take))
                parts.append(whole[at : at + take])
                at, held = at + take, held + take
                if held == chunk_rows:
                    yield chunk()
                    ids, parts, held = [], [], 0
        if held:
            yield chunk()

    vectors.mapInArrow(make, "ids array<long>, words array<binary>, codes array<binary>").write.parquet(path)
    return vectors.sparkSession.read.parquet(path)


def _chunks(batches: Iterator[pa.RecordBatch], dims: int, block: int) -> Iterator[tuple[pa.Array, Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].values, Chunk(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), dims, block)


def summed(chunks: DataFrame, centroids: np.ndarray, dims: int, block: int) -> DataFrame:
    """(cluster, rows, totals) of the whole table; totals: exact decimal sums by component."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk in _chunks(batches, dims, block):
            rows, sums = chunk.sums(chunk.assign(centroids)[0], len(centroids))
            used = np.flatnonzero(rows)
            at = np.repeat(used, dims), np.tile(np.arange(dims), len(used))
            columns = [at[0], at[1], np.repeat(rows[used], dims), sums[used].reshape(-1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "at", "rows", "total"])

    parts = chunks.mapInArrow(add, "cluster long, at long, rows long, total long")
    whole = parts.groupBy("cluster", "at").agg(F.sum("rows").alias("rows"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return whole.groupBy("cluster").agg(F.max("rows").alias("rows"), F.transform(F.array_sort(F.collect_list(F.struct("at", "total"))), lambda x: x["total"]).alias("totals"))


def assigned(chunks: DataFrame, centroids: np.ndarray, dims: int, block: int) -> DataFrame:
    """(id, cluster, distance) of every stored vector."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunk in _chunks(batches, dims, block):
            nearest, distance = chunk.assign(centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(nearest.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return chunks.mapInArrow(find, "id long, cluster int, distance long")


def draw(key) -> object:
    """What orders the vectors that may start a cluster."""
    return F.sha2(F.concat(F.lit("1:"), key.cast("string")), 256)


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, block: int = BLOCK, scale: int = SCALE, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that takes part.

    Vectors of another length, null ones and those with a null or non-finite component take no part. Rows
    of a null key are assigned but start no cluster; repeated rows count each by itself, also as starts,
    rows of one key in the order of their components. With fewer vectors than ``clusters`` there are that
    many clusters; without any, no rows. A vector with a whole number beyond 2 ** 27 has distances that
    may pass a long: it comes back with nulls and moves no centroid. An inertia beyond a long is null.
    """
    if chunk_rows > 1 << 16:
        raise ValueError("codes have 16 bits: a chunk holds 65,536 rows at most")
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "subvectors")
    doubles = F.col(f"`{vector}`").cast("array<double>")
    sound = (F.size(doubles) == dims) & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = df.where(F.coalesce(sound, F.lit(False))).select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(doubles, lambda x: F.when((x * scale >= -MOST) & (x * scale < MOST + 1), F.floor(x * scale)).cast("int")).alias("v"))
    fits = F.forall("v", lambda x: x.isNotNull())
    chunks = store(scaled.where(fits), path, dims, block, scale, chunk_rows)
    starts = scaled.where(fits & F.col("id").isNotNull()).orderBy(draw(F.col("id")), "id", "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in starts], np.int64).reshape(-1, dims)
    beyond = scaled.where(~fits).select("id")
    none = F.lit(None)
    outside = beyond.select(F.col("id").alias(key), none.cast("int").alias("cluster"), none.cast("long").alias("distance"), none.cast("long").alias("cluster_inertia"), none.cast("long").alias("inertia"), none.cast("string").alias("centroid_sha256"))
    if not len(centroids):
        unstarted = chunks.select(F.explode("ids").alias("id"))
        return outside.union(unstarted.select("id", *[none.cast(outside.schema[c].dataType).alias(c) for c in outside.columns[1:]]))
    for _ in range(rounds):
        # At most ``clusters`` rows of ``dims`` numbers.
        for r in summed(chunks, centroids, dims, block).collect():
            centroids[r["cluster"]] = [int(t) // r["rows"] for t in r["totals"]]
    placed = materialize(assigned(chunks, centroids, dims, block))
    inertia = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()
    whole = sum(int(r["sum"]) for r in inertia)
    held = lambda x: int(x) if x < 1 << 63 else None
    facts = spark.createDataFrame([(r["cluster"], held(r["sum"]), held(whole), centroid_digest(centroids[r["cluster"]])) for r in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").union(outside)
