"""Every operator and stage on columns of any name, repeated rows, nulls, long texts and empty tables."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dendrovox.llm import mixing, near_dups, packing, prefix_forest, progressive_jpeg, registry, secrets, sharding, toxicity, url_filters, warc

#: Names that some operator uses inside or gives to a column of its own.
NAMES = """row rank unit slot place block hash w at n node time i ends due rate turns base share slots first_cycle cycle size law region rack shard name later grown_shard best host path
 rule verdict _host _path _at _bucket _row _start _rank _n short digest rule_digest severity p_toxic grade score _score spans payload feature media n_bytes height width rgb document doc
 same keys sketch component component_id kept n_shingles label piece start length ids_crc32 sequence_id offset _file _line _bin _run key toxic page bytes keeper again value archive run_place
 capture_order id v q gap most segment string query_id problem""".split()
TEXTS = [None, "", "one two three", "password=hunter22x and more words", "x" * 70, "a b c d e f g", "a b c d e f g", "long words " * 60_000]


def table(spark, rows=None):
    rows = [(i, x, "en", "s1" if i % 3 else None, 5) for i, x in enumerate(TEXTS)] + [(1, "", "en", "s2", 0), (1, "", "en", "s2", 0), (None, "no key", "en", "s1", 6)] if rows is None else rows
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *[F.lit(77).alias(c) for c in NAMES])


def untouched(rows, but=()):
    return all(r[c] == 77 for r in rows for c in NAMES if c not in but and c in r.__fields__)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, "vile scum words" if i % 2 else "good words", i % 2) for i in range(60)], "doc_id long, text string, toxic int")
    return toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))


OPERATORS = {
    "media": (lambda t, m: progressive_jpeg.read_media(progressive_jpeg.store_media(t)), 11),
    "toxicity": (lambda t, m: toxicity.score(t, m), 11),
    "near_dups": (lambda t, m: near_dups.near_duplicates(t), 11),
    "keep_one": (lambda t, m: near_dups.keep_one(t), 10),
    "mixing": (lambda t, m: mixing.mix(t, block_rows=4), 11),
    "packing": (lambda t, m: packing.pack(t, registry.tokenizer_path()), None),
    "secrets": (lambda t, m: secrets.scan_secrets(t), 11),
    "redacted": (lambda t, m: t.withColumn("text", secrets.redacted(F.col("text"))), 11),
    "urls": (lambda t, m: url_filters.filter_urls(t.withColumn("url", F.col("text")), url_filters.RULES), 11),
    "shards": (lambda t, m: sharding.shard(t, sharding.even_tree(3), sharding.even_tree(4)), 11),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_take_any_column_names(spark, model, name):
    run, count = OPERATORS[name]
    frame = table(spark)
    rows = run(frame, model).collect()
    assert count is None or len(rows) == count
    if count is None:
        assert {r["doc_id"] for r in rows} == {*range(8), None} and len(rows) >= 11
    assert untouched(rows, {"media": NAMES, "packing": NAMES, "near_dups": NAMES, "toxicity": ("severity", "p_toxic", "grade"), "mixing": mixing.OUT, "urls": url_filters.OUT, "shards": sharding.OUT, "secrets": ("spans",)}.get(name, ()))
    assert run(table(spark, []), model).count() == 0


def test_archives_and_neighbours_take_any_column_names(spark, tmp_path):
    pages = table(spark).withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("url", F.lit("http://a/b"))
    warc.write_archives(pages, f"file://{tmp_path}/w")
    assert warc.captures(spark, f"file://{tmp_path}/w").count() == 11
    vectors = spark.range(30).selectExpr("id as vec_id", "array(cos(id), sin(id), 1.0) as embedding").select("*", *[F.lit(77).alias(c) for c in NAMES])
    assert prefix_forest.nearest(vectors.union(vectors)).count() == 10


def test_huge_and_tiny_vectors_keep_their_distances(spark):
    vectors = {0: [1e200, 0.0], 1: [1e200, 3e199], 2: [-1e200, 1.0], 3: [1e-200, 0.0], 100: [1e-200, 2e-200], 4: [5.0, 1.0]}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in prefix_forest.nearest(frame).collect()}
    assert set(got) == {(q, i) for q in (0, 100) for i in vectors if i != q}
    assert got[0, 1] == pytest.approx(3e199) and got[0, 2] == pytest.approx(2e200) and got[100, 3] == pytest.approx(2e-200)


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_every_column_as_it_was(spark, tmp_path, k):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(i, 1, int(i == 3)) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    _, stage = corpus_pipeline.STAGES[k]
    for rows, path in ((None, "some"), ([], "none")):
        table(spark, rows).write.parquet(f"{folder}/{path}")
        docs = spark.read.parquet(f"{folder}/{path}")
        out = stage(spark, docs, folder)
        got = out.collect()
        assert len(got) >= (0 if rows == [] else 9) and (rows is None or not got)
        if k < 4:
            assert out.columns == docs.columns and untouched(got)


def test_a_long_text_takes_time_in_proportion():
    part = "token=abcDEF123456 0123456789abcdef0123456789abcdef Zx9Qw8Er7Ty6Ui5Op4As3 "
    scan, took = secrets.Scanner(), []
    for times in (2000, 16_000):
        start = time.perf_counter()
        assert len(scan(part * times)) >= 2 * times
        took.append(time.perf_counter() - start)
    assert took[1] < 24 * took[0]


def test_a_repeated_key_counts_once_in_the_sample(spark):
    docs = spark.createDataFrame([(1, "vile scum")] * 500 + [(i, "vile scum" if i % 2 else "good") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0)] * 9, "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit

    def watched(rows, *rest):
        seen.append(len(rows))
        return fit(rows, *rest)

    toxicity.fit = watched
    try:
        toxicity.train(docs, labels, sample_rows=40)
    finally:
        toxicity.fit = fit
    assert seen == [40]


def test_the_fit_matches_a_plain_one():
    """The same objective minimized by plain steps over dense arrays: cuts, severity and grades agree."""
    rng = np.random.default_rng(5)
    chosen, rows = [f"f{j}" for j in range(6)], []
    for i in range(240):
        toxic = i % 3 == 0
        counts = rng.poisson([1.5, 1.0, 0.8, 0.1, 0.1, 0.1] if toxic else [0.1, 0.1, 0.1, 1.0, 1.0, 0.5])
        rows.append({"toxic": int(toxic), "place": np.flatnonzero(counts).tolist(), "n": counts[counts > 0].tolist()})
    model = toxicity.fit(rows, chosen, ["f0", "f1", "f2"])
    x, load = np.zeros((240, 6)), np.zeros(240)
    for i, r in enumerate(rows):
        x[i, r["place"]] = np.log1p(r["n"])
        load[i] = sum(n for j, n in zip(r["place"], r["n"]) if j < 3)
    y = np.array([r["toxic"] for r in rows])
    grade = np.where(y == 1, 1 + (load[:, None] > np.quantile(load[y == 1], [1 / 3, 2 / 3])).sum(1), 0)
    above, weight = (grade[:, None] > np.arange(3)).astype(float), np.where(y == 1, 240 / (2 * y.sum()), 240 / (2 * (240 - y.sum())))[:, None] / 240

    def loss(w, cuts):
        z = (x @ w)[:, None] - cuts
        return float((weight * (np.logaddexp(0, z) - above * z)).sum())

    w, cuts = np.zeros(6), np.zeros(3)
    for step in range(20_000):
        error = (1 / (1 + np.exp(-((x @ w)[:, None] - cuts))) - above) * weight
        w, cuts = w - 0.5 * x.T @ error.sum(1), np.sort(cuts + 0.5 * error.sum(0))
    mine = np.array([model.weights.get(f, 0.0) for f in chosen])
    assert loss(mine, model.cuts) <= loss(w, cuts) * 1.05
    probability = lambda a, b: 1 / (1 + np.exp(-((x @ a)[:, None] - b)))
    assert np.abs(probability(mine, model.cuts).sum(1) - probability(w, cuts).sum(1)).mean() < 0.1
    scorer = model.scorer()
    text = "f0"
    model.weights[text] = 2.0
    total = 2.0 * np.log1p(2)
    got = toxicity.OrdinalModel({"xy": 2.0}, model.cuts).scorer().score("xy xy")
    want = 1 / (1 + np.exp(-(total - model.cuts)))
    assert got["severity"] == pytest.approx(want.sum()) and got["grade"] == int((want >= 0.5).sum()) and scorer is not None
