"""Toxicity by cumulative-link ordinal regression over sparse word and word-prefix features.

P(grade > k) = sigmoid(w . x - cut[k]) with one w for all ordered cuts; x holds log(1 + count) of
each word and of each word's first four and five letters. The expected severity is the sum of the
P(grade > k). Training reads a bounded hash sample of labelled rows; scoring reads every row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrovox.plans.durable import materialize

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)
GRADES = 4
SAMPLE_ROWS = 12_000
FEATURE_ROWS = 3
#: Features in more than this share of the sampled rows tell grades apart by length alone.
COMMON = 0.2
ASSOCIATION = 4.0
L1 = 2e-5
ROUNDS = 300
SCORE = "struct<severity:double,p_toxic:double,grade:int>"
ARROW_SCORE = pa.struct([("severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32())])


def features_of(word: str) -> tuple[str, ...]:
    """A word and its prefixes; the prefixes are marked by their length."""
    return (word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[str, float]
    cuts: np.ndarray

    def scorer(self) -> _Scorer:
        return _Scorer(self)


class _Scorer(dict):
    """Known features of each word seen; most words have none."""

    LIMIT = 100_000

    def __init__(self, model: OrdinalModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found = tuple(x for x in features_of(word) if x in self.model.weights)
        return found

    def score(self, text: str | None) -> dict:
        hits = Counter(x for found in map(self.__getitem__, WORD.findall((text or "").lower())) if found for x in found)
        total = sum(self.model.weights[x] * np.log1p(n) for x, n in sorted(hits.items()))
        above = _sigmoid(total - self.model.cuts)
        return {"severity": float(above.sum()), "p_toxic": float(above[0]), "grade": int((above >= 0.5).sum())}


def _counted(rows: DataFrame) -> DataFrame:
    """Feature counts of each sampled text, made on the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, names, counts = [], [], []
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                c = Counter(x for w in WORD.findall((text.as_py() or "").lower()) for x in features_of(w))
                toxic.append(int(y))
                names.append(list(c))
                counts.append(list(c.values()))
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))], names=["toxic", "names", "counts"])

    return rows.mapInArrow(count, "toxic int, names array<string>, counts array<int>")


def _features(counted: DataFrame, rows: int, positive: int) -> tuple[list[str], list[str]]:
    """The features bound to either class, the strongest first, and those that mostly toxic rows have.

    All features of the bounded sample that pass the test of association are taken.
    """
    rate = positive / rows
    stats = counted.select("toxic", F.explode("names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("seen"), F.sum("toxic").alias("bound"))
    stats = stats.where(F.col("seen").between(FEATURE_ROWS, int(max(COMMON * rows, positive))))
    stats = stats.withColumn("z", (F.col("bound") - F.col("seen") * rate) / F.sqrt(F.col("seen") * (rate * (1 - rate))))
    best = stats.where(F.abs("z") >= ASSOCIATION).orderBy(F.abs("z").desc(), "name").collect()
    return [r["name"] for r in best], [r["name"] for r in best if r["z"] > 0 and r["bound"] >= 0.8 * r["seen"]]


def _indexed(counted: DataFrame, chosen: list[str]) -> DataFrame:
    """Rows (toxic, place, n) with the places and counts of the chosen features only."""
    shared = counted.sparkSession.sparkContext.broadcast({x: j for j, x in enumerate(chosen)})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found = [[(index[x], n) for x, n in zip(a, b, strict=True) if x in index] for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            parts = [pa.array([[x[i] for x in row] for row in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *parts], names=["toxic", "place", "n"])

    return counted.select("toxic", "names", "counts").mapInArrow(pick, "toxic int, place array<int>, n array<int>")


def fit(rows: list, chosen: list[str], strong: list[str]) -> OrdinalModel:
    """Fit on rows (toxic, place, n) over the features ``chosen``.

    Both classes weigh the same in all. The labels are 0 or 1, so the grades above 0 are weak ones:
    toxic rows are cut at the thirds of their count of ``strong`` features.
    """
    toxic = np.asarray([r["toxic"] for r in rows], np.int64)
    n, positive = len(rows), int(toxic.sum())
    index = {x: j for j, x in enumerate(chosen)}
    bound = np.zeros(len(chosen), bool)
    bound[[index[x] for x in strong]] = True
    row = np.repeat(np.arange(n), [len(r["place"]) for r in rows])
    column = np.asarray([j for r in rows for j in r["place"]], np.int64)
    count = np.asarray([c for r in rows for c in r["n"]], np.float64)
    value = np.log1p(count)

    load = np.bincount(row, count * bound[column], minlength=n)
    thirds = np.quantile(load[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic == 1, 1 + (load[:, None] > thirds).sum(1), 0)
    above = (grade[:, None] > np.arange(GRADES - 1)).astype(float)

    weight = np.where(toxic == 1, n / (2.0 * positive), n / (2.0 * (n - positive)))[:, None] / n
    w = np.zeros(len(chosen))
    rates = (above * weight).sum(0).clip(1e-4, 1 - 1e-4)
    cuts = np.log((1 - rates) / rates)
    speed_w, speed_c = np.full(len(chosen), 1e-8), np.full(GRADES - 1, 1e-8)
    for _ in range(ROUNDS):
        score = np.bincount(row, w[column] * value, minlength=n)
        error = (_sigmoid(score[:, None] - cuts) - above) * weight
        g = np.bincount(column, error.sum(1)[row] * value, minlength=len(chosen))
        gc = -error.sum(0)
        speed_w += g * g
        speed_c += gc * gc
        step = 0.5 / np.sqrt(speed_w)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
        cuts = np.maximum.accumulate(cuts - 0.5 / np.sqrt(speed_c) * gc)
    return OrdinalModel({x: float(w[j]) for x, j in index.items() if w[j]}, cuts)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> OrdinalModel:
    """Fit on about ``sample_rows`` labelled keys, chosen by a hash of the key; never more than twice as many.

    A key counts once, however often documents or labels repeat it: any toxic label makes it toxic,
    and of its texts the one of the least hash is read. Null keys and null labels take no part, a
    null text has no words. Without rows of both classes, or without any feature
    bound to the toxic one, the model knows no feature and scores every text by the class rate.
    """
    known = labels.where(F.col(toxic).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    share = min(1.0, sample_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 20)) < F.lit(round(share * (1 << 20)))).limit(2 * sample_rows)
    met = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key")
    once = met.groupBy("key").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    counted = materialize(_counted(once.select("text", "toxic")))
    n, positive = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    chosen, strong = _features(counted, n, positive) if 0 < positive < n else ([], [])
    if not strong:
        rate = (positive + 0.5) / (n + 2.0)
        return OrdinalModel({}, np.log((1 - rate) / rate) + np.arange(GRADES - 1, dtype=float))
    rows = _indexed(counted, chosen).collect()
    return fit(sorted(rows, key=lambda r: (r["toxic"], r["place"], r["n"])), chosen, strong)


def score(df: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``df`` with severity, p_toxic and grade; a null text scores as an empty one, every row stays.

    Repeated rows score alike, whole texts are read, an empty table stays empty. Columns named
    severity, p_toxic or grade are replaced; any other name is free.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(SCORE)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = shared.value.scorer()
        for texts in batches:
            yield pa.array([scorer.score(x.as_py()) for x in texts], ARROW_SCORE)

    own = ("severity", "p_toxic", "grade")
    kept = [c for c in df.columns if c not in own]
    found = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), scored(F.col(f"`{text}`")).alias("score"))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *[F.col(f"score.{c}").alias(c) for c in own])


def rejects(threshold: float = 0.5) -> Column:
    return F.col("p_toxic") >= F.lit(threshold)
