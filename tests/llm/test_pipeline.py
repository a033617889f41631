"""The pipeline against a plain version of every stage."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from dendrovox.llm import mixing, packing, registry, secrets, toxicity
from tests.llm.test_groups_and_order import brute_components

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def make_tables(spark, folder):
    random.seed(9)
    clean, bad = [f"w{i}" for i in range(500)], ["scum", "moron", "vile"]
    rows, labels = [], []
    for i in range(240):
        words = random.choices(clean, k=random.randint(8, 60))
        if i % 6 == 0:
            for w in random.choices(bad, k=3):
                words.insert(random.randrange(len(words)), w)
        elif i % 10 == 1 and i > 1:
            words = rows[-2][1].split(" ")
            words[0] = "changed" if len(words) > 50 else words[0]
        elif i % 10 == 3:
            words.insert(3, "password=hunter22x")
        rows.append((i, " ".join(words), "en", random.choice(["a", "a", "a", "b", "c", None]), 0))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(240, None, None, "a", 0), (241, "", "en", "b", 0), (242, "w1 " * 9000, "en", "b", 0)]
    rows = [(a, t, b, c, len(t or "")) for a, t, b, c, _ in rows]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {r[0]: r[1] for r in rows}


def test_pipeline_matches_plain_stages(spark, tmp_path):
    folder = f"file://{tmp_path}/tables"
    texts = make_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][:2] == ["toxicity", "minhash near-dedup"] and len(corpus_pipeline.STAGES) == 5

    scorer = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet")).scorer()
    kept = {k: x for k, x in texts.items() if scorer.score(x)["p_toxic"] < 0.5}
    assert all(k not in kept for k in range(0, 240, 6)) and len(kept) >= 200
    kept = {k: kept[k] for k, (_, part) in brute_components(kept).items() if part == k}
    scan = secrets.Scanner()
    for k, x in kept.items():
        for s in reversed(scan(x)):
            kept[k] = kept[k][: s["start"]] + "<secret>" + kept[k][s["end"] :]
    tokenizer = Tokenizer.from_file(registry.tokenizer_path())
    want = {}
    for k, x in kept.items():
        ids = np.array([*tokenizer.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            want[k, piece] = (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(used) == -(-sum(r["length"] for r in got) // 4096)


def test_stages_keep_the_columns_and_the_clean_documents(spark, tmp_path):
    folder = f"file://{tmp_path}/tables"
    texts = make_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[2:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == len(texts), name
    placed = corpus_pipeline.mix_sources(spark, docs, folder).collect()
    assert {r["doc_id"]: r["text"] for r in placed} == texts


def test_sequences_follow_the_mixture(spark, tmp_path):
    rows = [(i, "one two three four five " * 12, "en", "a" if i < 500 else "b" if i < 560 else "c", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    place = {r["doc_id"]: r["place"] for r in mixing.mix(docs).collect()}
    written = f"file://{tmp_path}/mixed"
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(written)
    got = corpus_pipeline.pack_sequences(spark, spark.read.parquet(written), "").collect()
    assert len({r["sequence_id"] for r in got}) > 3
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))] == sorted(place, key=place.get)


def test_sequences_are_numbered_by_their_first_piece(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, "one two three " * rng.choice([5, 40, 300, 900, 2000]), "en", "a", 0) for i in range(120)]
    written = f"file://{tmp_path}/files"
    spark.createDataFrame(rows, DOCUMENTS).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.parquet(written)
    first = {}
    for r in corpus_pipeline.pack_sequences(spark, spark.read.parquet(written), "").collect():
        first[r["sequence_id"]] = min(first.get(r["sequence_id"], (999, 0)), (r["doc_id"], r["piece"]))
    assert sorted(first) == list(range(len(first))) and [first[s] for s in sorted(first)] == sorted(first.values())


def test_a_sequence_holds_pieces_of_one_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "RUN_ROWS", 50)
    rng = random.Random(7)
    rows = [(i, "one two three " * rng.choice([5, 40, 300, 900]), "en", "a", 0) for i in range(150)]
    written = f"file://{tmp_path}/files"
    spark.createDataFrame(rows, DOCUMENTS).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.parquet(written)
    runs = {}
    for r in corpus_pipeline.pack_sequences(spark, spark.read.parquet(written), "").collect():
        runs.setdefault(r["sequence_id"], set()).add(r["doc_id"] // 50)
    assert [runs[s] for s in sorted(runs)] == sorted(runs.values(), key=min) and all(len(x) == 1 for x in runs.values())
