"""MinHash near-duplicates: banded universal-hash minima, exact confirmation, star components.

Texts of equal words are first one class, held by its least document. Each class gets ``BANDS`` keys
of ``ROWS`` minima. Classes that share a key may be linked; pairs whose sizes or parity maps rule the
threshold out are put aside without loss, all others are confirmed on their full shingle sets, fragment
by fragment (``fragments``). A pair at the threshold of 0.85 misses every band with probability
(1 - 0.85 ** 7) ** 40 = 2e-7; nothing else is left to chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendrovox.llm import fragments
from dendrovox.llm.fragments import mixed
from dendrovox.plans.durable import scratch_path

SHINGLE = 5
BANDS, ROWS = 40, 7
SEED = 20240229


class MinHash:
    """``bands * rows`` minima of a x + b modulo 2 ** 32 over the folded hashes of a set."""

    BLOCK = 1024

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> None:
        random = np.random.default_rng(seed)
        n = bands * rows
        self.bands, self.rows = bands, rows
        self.a = (random.integers(0, 1 << 32, n, np.uint64) | 1).astype(np.uint32)[:, None]
        self.b = random.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)[:, None]
        self.spread = random.integers(0, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)
        self.room = np.empty((n, self.BLOCK), np.uint32)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        best = None
        for at in range(0, len(x), self.BLOCK):
            part = x[None, at : at + self.BLOCK]
            room = self.room[:, : part.shape[1]]
            np.multiply(self.a, part, out=room)
            room += self.b
            low = room.min(axis=1)
            best = low if best is None else np.minimum(best, low)
        return best

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key a band, of each row of minima."""
        parts = minima.reshape(-1, self.bands, self.rows).astype(np.uint64) + np.uint64(1)
        total = mixed(parts * self.spread).sum(axis=2, dtype=np.uint64) + np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mixed(total).view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc, n, class, same, keys, bits) of rows (doc, text); without words: 0 and nulls."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash()
        longs = pa.list_(pa.int64())
        for batch in batches:
            n, same, keys, bits = [], [], [], []
            for text in batch.column(1):
                words = fragments.words_of(text.as_py())
                shingles = fragments.shingle_set(words, SHINGLE)
                n.append(len(shingles))
                same.append(fragments.same_words(words))
                keys.append(minhash.keys(minhash.minima(shingles))[0] if words else None)
                bits.append(fragments.parity_map(shingles) if words else None)
            same = pa.array(same, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), same, same, pa.array(keys, longs), pa.array(bits, longs)], names=["doc", "n", "class", "same", "keys", "bits"])

    return docs.mapInArrow(make, "doc long, n long, class binary, same binary, keys array<long>, bits array<long>")


def near_duplicates(df: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``df``.

    Rows without words are linked with nothing. Rows of a null key take no part: their component is
    null and they are not kept. Repeated rows each come back; a key with several texts is one document
    in as many classes (see ``fragments.by_class``). Other columns are left out.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    path = scratch_path(spark, "minhash")
    fingerprints(docs).write.parquet(f"{path}/prints")

    out = fragments.by_class(spark.read.parquet(f"{path}/prints"), percent, fragments.segment_tables(docs, SHINGLE, path), path, key)
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def keep_one(df: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df`` but the near-duplicates: one of each component stays; null keys all stay.

    Rows that repeat the key that stays all stay; columns keep their values, whatever their names.
    """
    path = scratch_path(df.sparkSession, "copies")
    near_duplicates(df.where(F.col(key).isNotNull()), percent, key, text).where(~F.col("kept")).select(key).distinct().write.parquet(path)
    return df.join(df.sparkSession.read.parquet(path), key, "left_anti")
