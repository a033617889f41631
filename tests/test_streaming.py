import random
from collections import deque

import numpy as np
import pytest

from dendrovox.streaming import histograms


def plain_feedback(planes, history, decay):
    """The rule value by value: the least past value that reaches the share, one up if that is there too."""
    out, past = {}, []
    for z in sorted(planes):
        values, goes = planes[z], {}
        for v in set(values):
            goes[v] = v
            if len(past) >= history:
                known = sorted((p, decay**i) for i, plane in enumerate(past[:history]) for p in plane)
                whole, share = sum(w for _, w in known), sum(x <= v for x in values) / len(values)
                to = min(p for p, _ in known if sum(w for x, w in known if x <= p) / whole >= share - 1e-12)
                goes[v] = to + ((to + 1) in {p for p, _ in known})
            out[z, v] = goes[v]
        past.insert(0, [goes[v] for v in values])
    return out


def make_planes(seed):
    rng = random.Random(seed)
    return {z: [min(int(rng.expovariate(1 / 12)), 90) for _ in range(50)] for z in range(8)}


@pytest.mark.parametrize("decay", [1.0, 0.5])
def test_batch_matches_plain_rule(spark, decay):
    both = {s: make_planes(s) for s in (0, 1)}
    frame = spark.createDataFrame([(s, z, v) for s, planes in both.items() for z, values in planes.items() for v in values], "sequence long, z long, v long")
    got = {}
    for r in histograms.match_with_feedback(frame, 2, decay).collect():
        got.setdefault(r["sequence"], {})[r["z"], r["v"]] = r["matched"]
    assert got == {s: plain_feedback(planes, 2, decay) for s, planes in both.items()}


def test_stream_equals_batch(spark, tmp_path):
    planes = make_planes(4)
    want = plain_feedback(planes, 3, 1.0)
    schema, got = "sequence long, z long, v long, n long", {}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

    def keep(batch, _):
        for r in batch.collect():
            got[r["z"], r["v"]] = r["matched"]

    matched = histograms.match_stream(source, 3)
    for first in (0, 3, 6):
        rows = [(0, z, v, planes[z].count(v)) for z in range(first, min(first + 3, 8)) for v in set(planes[z])]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        matched.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert got == want


def test_planes_stay_while_history_fills():
    past = deque(maxlen=2)
    values = np.array([3, 9])
    assert (histograms.match_plane(past, values, np.array([1.0, 1.0]), 1.0) == values).all() and len(past) == 1
