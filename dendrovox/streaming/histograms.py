"""Histogram matching with feedback: each plane is matched to the planes matched before it.

Only histograms are kept, never voxels: in a batch all of a sequence's in one group, in a stream the
last ``history`` of them as the sequence's state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Histogram = tuple[np.ndarray, np.ndarray]
MATCHED = "sequence long, z long, v long, matched long"


def match_plane(past: deque[Histogram], values: np.ndarray, counts: np.ndarray, decay: float) -> np.ndarray:
    """Where each of a plane's ascending ``values`` goes; ``past`` has the latest histogram first and is brought up to date.

    A value goes to the least past value whose share reaches its own, one step up if the past holds
    that next value too. While ``past`` is not full, planes stay as they are.
    """
    matched = values
    if len(past) == past.maxlen:
        known, at = np.unique(np.concatenate([v for v, _ in past]), return_inverse=True)
        weight = np.bincount(at, np.concatenate([n * decay**i for i, (_, n) in enumerate(past)]))
        share, own = np.cumsum(weight) / weight.sum(), np.cumsum(counts) / counts.sum()
        to = np.minimum(np.searchsorted(share, own - 1e-12), len(known) - 1)
        after = known[np.minimum(to + 1, len(known) - 1)]
        matched = np.where(after == known[to] + 1, after, known[to])
    merged, at = np.unique(matched, return_inverse=True)
    past.appendleft((merged, np.bincount(at, counts)))
    return matched


def match_with_feedback(planes: DataFrame, history: int, decay: float = 1.0) -> DataFrame:
    """(sequence, z, v, matched) of planes (sequence, z, v): sequences apart, the planes of each in order of z."""
    counts = planes.groupBy("sequence", "z", "v").agg(F.count(F.lit(1)).alias("n"))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("z", "ascending"), ("v", "ascending")])
        z, v, n = (part.column(c).to_numpy() for c in ("z", "v", "n"))
        past: deque[Histogram] = deque(maxlen=history)
        cuts = [0, *(np.flatnonzero(np.diff(z)) + 1).tolist(), len(z)]
        matched = [match_plane(past, v[a:b], n[a:b].astype(float), decay) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        return pa.table({"sequence": part.column("sequence"), "z": z, "v": v, "matched": np.concatenate(matched) if matched else v})

    return counts.groupBy("sequence").applyInArrow(run, MATCHED)


def match_stream(histograms: DataFrame, history: int, decay: float = 1.0) -> DataFrame:
    """As ``match_with_feedback`` for a stream of histograms (sequence, z, v, n); a plane comes whole, in one batch, in order of z."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past: deque[Histogram] = deque(maxlen=history)
        if state.exists:
            sizes, values, counts = state.get
            ends = np.cumsum([0, *sizes])
            past.extend((np.array(values[a:b], np.int64), np.array(counts[a:b])) for a, b in zip(ends, ends[1:]))
        rows = pd.concat(list(frames)).sort_values(["z", "v"])
        for z, plane in rows.groupby("z", sort=True):
            v = plane["v"].to_numpy()
            yield pd.DataFrame({"sequence": key[0], "z": z, "v": v, "matched": match_plane(past, v, plane["n"].to_numpy(float), decay)})
        state.update(([len(v) for v, _ in past], [int(x) for v, _ in past for x in v], [float(x) for _, n in past for x in n]))

    held = "sizes array<int>, held_values array<long>, counts array<double>"
    return histograms.groupBy("sequence").applyInPandasWithState(run, MATCHED, held, "append", GroupStateTimeout.NoTimeout)
