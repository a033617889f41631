"""The n-gram join against all pairs, and what its keys promise."""

import random
import re

import numpy as np
import pytest

from dendrovox.llm import fragments, ngram_join
from tests.llm.test_groups_and_order import near_texts


def grams(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not words else {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(texts, percent=85, width=4):
    """{doc: (n, component)} by comparing all pairs."""
    sets = {k: grams(x, width) for k, x in texts.items()}
    parent = {k: k for k in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def edges_of_the_threshold():
    """Short and long texts whose overlaps lie on and beside the threshold, and passages that many share."""
    random.seed(11)
    words, texts = [f"w{i}" for i in range(3000)], []
    for n in (1, 2, 3, 4, 5, 6, 9, 10, 11, 16, 17, 26, 40, 67, 68, 120, 300):
        base = random.choices(words, k=n)
        texts += [" ".join(base), " ".join(base).upper(), " ".join([*base, "tail"]), "\t".join(["head", *base])]
        for cut in (1, 2, 3, n // 10, n // 7, n // 6):
            texts.append(" ".join(base[: max(1, n - cut)]))
    passage = random.choices(words, k=60)
    texts += [" ".join(passage + random.choices(words, k=k)) for k in (3, 4, 5, 8, 11, 12, 30, 60) for _ in range(5)]
    return [*texts, None, "", " \t ", "loop " * 50, "loop " * 51]


@pytest.mark.parametrize("make", [near_texts, edges_of_the_threshold])
def test_join_matches_all_pairs(spark, make):
    texts = dict(enumerate(make()))
    frame = spark.createDataFrame([(k, x, 1, "n") for k, x in texts.items()], "doc_id long, text string, component_id int, u string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(frame).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("percent, width", [(60, 2), (100, 3)])
def test_other_thresholds_and_widths(spark, percent, width):
    texts = dict(enumerate(near_texts()))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(frame, percent, width).collect()}
    assert got == brute(texts, percent, width)


def test_linked_sets_share_a_key():
    """Any two sets at the threshold have a key in common, whichever members differ."""
    rng, levels = np.random.default_rng(3), ngram_join.Levels()
    for trial in range(3000):
        n = int(rng.integers(1, 90)) if trial % 3 else int(rng.integers(90, 900))
        both = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
        if trial % 5 == 0:  # members crowded into one part of the order leave fragments empty
            both >>= np.uint64(rng.integers(0, 8))
        both = np.unique(both)
        apart = int(len(both) * 15 / 85)
        more = rng.integers(0, 1 << 63, apart, np.uint64)
        split = int(rng.integers(0, apart + 1))
        u, v = np.union1d(both, more[:split]), np.union1d(both, more[split:])
        shared = len(np.intersect1d(u, v))
        if 100 * shared >= 85 * (len(u) + len(v) - shared) and len(u) + len(v) > 2 * shared:
            assert np.intersect1d(levels.keys(u), levels.keys(v)).size, (trial, len(u), len(v))


def test_parity_maps_never_differ_more_than_sets():
    rng = np.random.default_rng(4)
    for n in (0, 1, 50, 5000):
        u, v = (np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)) for _ in "uv")
        u = np.union1d(u, v[: n // 2])
        apart = np.unpackbits((fragments.parity_map(u) ^ fragments.parity_map(v)).view(np.uint8)).sum()
        assert apart <= len(np.setxor1d(u, v))


def test_hot_keys_are_dealt_to_tasks_and_lose_no_row(spark):
    rows = [(7, i) for i in range(3000)] + [(8, 1), (8, 2), (9, 5), (10, 6), (10, 6)]
    keyed = spark.createDataFrame(rows, "key long, doc long")
    got = sorted((r["key"], r["doc"]) for r in fragments.crowded(keyed, 100).collect())
    assert got == sorted(r for r in rows if r[0] in (7, 8))


def test_a_join_with_hot_keys_stays_whole(spark):
    base = [f"w{i}" for i in range(200)]
    texts = {k: " ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(150)} | {900: " ".join(base)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(frame, hot_rows=20).collect()}
    assert got == brute(texts)


def test_null_keys_repeated_rows_and_no_rows(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, "a b c d e"), (4, None), (5, ""), (6, "a b"), (7, "A B"), (8, "one text of this key"), (8, "a b c d e")]
    got = sorted(map(tuple, ngram_join.jaccard_join(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 2, None), (2, 2, 2), (2, 2, 2), (3, 2, 2), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 2, 8), (8, 2, 2)], key=str)
    assert ngram_join.jaccard_join(spark.createDataFrame([], schema)).count() == 0


def test_one_key_with_two_texts_has_one_result(spark):
    """Twice in different orders: both runs hold the same text against the others."""
    rows = [(1, "a b c d e f g h"), (1, "p q r s t u v w"), (2, "a b c d e f g h"), (3, "p q r s t u v w x"), (4, "p q r s t u v w")]
    runs = [sorted(map(tuple, ngram_join.jaccard_join(spark.createDataFrame(r, "doc_id long, text string").repartition(k)).collect())) for r, k in ((rows, 1), (rows[::-1], 3))]
    assert runs[0] == runs[1]
