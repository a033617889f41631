"""N-gram Jaccard join by vertical partitioning, without loss.

All sets follow one global order of n-grams (``fragments``). Sets of about one size cut it into m even
fragments, m a little above the number of n-grams in which two linked sets of that size can differ. Each
differing n-gram spoils one fragment, so linked sets agree on the whole of some fragment: its content,
hashed, is a key that they share. Sets that agree on none have no link, exactly, and go no further. An
empty fragment is no key; m leaves room for as many as a set has, and the few sets with more empty
fragments than that share one more key of their own. For the pairs that meet, overlaps are counted in
fixed fragments apart and summed.

Sizes are dealt to levels; a set takes part in its own level and in the next where a partner may be.
A hot passage makes no bucket: it would have to fill whole fragments in both texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendrovox.llm import fragments
from dendrovox.llm.fragments import mixed
from dendrovox.plans.durable import scratch_path

WIDTH, PERCENT = 4, 85
#: Sizes of a level: from one bound to the next, this many times larger.
SPREAD = 1.6


class Levels:
    """For set sizes: the levels they take part in and how many fragments each has."""

    def __init__(self, percent: int = PERCENT) -> None:
        if not 0 < percent <= 100:
            raise ValueError("percent is from 1 to 100")
        self.percent, self.bounds = percent, []

    def most_apart(self, sizes: int) -> int:
        """Members by which two linked sets of ``sizes`` members together can differ."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def _bound(self, k: int) -> int:
        """The least size of level k; sets below the first are linked with equal ones only."""
        if not self.bounds:
            least = 1
            while not self.most_apart(2 * least):
                least += 1
            self.bounds.append(least)
        while len(self.bounds) <= k:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * SPREAD)))
        return self.bounds[k]

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(level, fragments, empty fragments without harm) for each level that a set of n members takes part in."""
        if self.percent == 100:
            return []
        out, k = [], 0
        while 100 * n >= self.percent * self._bound(k):
            if n < self._bound(k + 1):
                apart = self.most_apart(2 * (self._bound(k + 1) - 1))
                spare = 2 + apart // 12
                out.append((k, apart + 1 + spare, spare))
            k += 1
        return out

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key for each fragment with members, of each level."""
        out = [np.empty(0, np.uint64)]
        content = mixed(shingles)
        for level, parts, spare in self.of(len(shingles)):
            at = (shingles >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            place = at[starts] + np.uint64(level << 40)
            out.append(mixed(np.add.reduceat(content, starts) + mixed(place + np.uint64(1))))
            if parts - len(starts) > spare:
                out.append(mixed(np.asarray([(level << 40) + (1 << 39)], np.uint64)))
        return np.concatenate(out).view(np.int64)


def fingerprints(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc, n, class, same, keys, bits) of rows (doc, text); class: the digest of the set; without words: 0 and nulls."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(percent)
        longs = pa.list_(pa.int64())
        for batch in batches:
            n, sets, same, keys, bits = [], [], [], [], []
            for text in batch.column(1):
                words = fragments.words_of(text.as_py())
                shingles = fragments.shingle_set(words, width)
                n.append(len(shingles))
                sets.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if words else None)
                same.append(fragments.same_words(words))
                keys.append(levels.keys(shingles) if words else None)
                bits.append(fragments.parity_map(shingles) if words else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(same, pa.binary()), pa.array(keys, longs), pa.array(bits, longs)], names=["doc", "n", "class", "same", "keys", "bits"])

    return docs.mapInArrow(make, "doc long, n long, class binary, same binary, keys array<long>, bits array<long>")


def jaccard_join(df: DataFrame, percent: int = PERCENT, width: int = WIDTH, key: str = "doc_id", text: str = "text", hot_rows: int = fragments.HOT_ROWS) -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``df``.

    Rows without words have an empty set and are linked with nothing, not even each other. Rows of a
    null key take no part: their component is null. Repeated rows each come back; a key with several
    texts is one document in as many classes of equal sets. Other columns are left out; an empty table
    gives no rows. Every pair of sets that reaches ``percent`` is found.
    """
    if not 1 <= width <= fragments.LONGEST:
        raise ValueError(f"width is from 1 to {fragments.LONGEST}")
    spark = df.sparkSession
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    path = scratch_path(spark, "ngrams")
    fingerprints(docs, width, percent).write.parquet(f"{path}/prints")

    return fragments.by_class(spark.read.parquet(f"{path}/prints"), percent, fragments.segment_tables(docs, width, path), path, key, hot_rows)
