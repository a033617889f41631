import collections
import gzip
import hashlib
import math
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrovox.llm import mixing, near_dups, packing, prefix_forest, registry, sharding, toxicity, warc
from dendrovox.llm.warc import LoserTree


def brute_components(texts, percent=85):
    def words(x):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))

    sets = {}
    for k, x in texts.items():
        w = words(x)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def near_texts():
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = random.choices(vocabulary, k=90)
    texts = [None, "", " \t\n", "one", "ONE", "one two three", "A b C d E", "a B c D e", "é É ünder", "a\x0bb"]
    for _ in range(12):
        base = random.choices(vocabulary, k=random.randint(40, 200))
        texts.append(" ".join(base))
        for _ in range(random.randint(0, 6)):
            copy = list(base)
            for _ in range(random.randint(0, 5)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            texts.append(" ".join(copy))
    for _ in range(10):
        texts.append(" ".join(passage + random.choices(vocabulary, k=random.randint(5, 60))))
    chain = random.choices(vocabulary, k=120)
    for step in range(12):
        texts.append(" ".join(chain[step * 3 : step * 3 + 90]))
    texts += [texts[20]] * 5
    return texts


def test_near_duplicates_match_brute_force(spark):
    texts = dict(enumerate(near_texts()))
    frame = spark.createDataFrame([(k, x, 1, "n") for k, x in texts.items()], "doc_id long, text string, component_id int, n_shingles string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dups.near_duplicates(frame).collect()}
    want = brute_components(texts)
    assert got == want
    kept = {r["doc_id"] for r in near_dups.keep_one(frame).collect()}
    assert kept == {k for k, (_, c) in want.items() if k == c}


def test_near_duplicates_without_rows_and_with_null_keys(spark):
    schema = "doc_id long, text string"
    assert near_dups.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = near_dups.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in rows if r["doc_id"]) == [(2, 2, True)] * 2
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, False)]


# ---- op2


def test_toxicity_on_held_out_rows(spark):
    random.seed(4)
    clean = [f"w{i}" for i in range(400)]
    bad = [f"vile{i}" for i in range(40)] + ["scum", "moron"]
    rows, labels = [], []
    for i in range(600):
        words = random.choices(clean, k=random.randint(5, 80))
        toxic = i % 5 == 0
        if toxic:
            for w in random.choices(bad, k=random.randint(1, 4)):
                words.insert(random.randrange(len(words)), w)
        rows.append((i, " ".join(words), int(toxic)))
        if i < 400:
            labels.append((i, int(toxic)))
    rows += [(600, None, 0), (601, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity int")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).withColumn("toxic", toxicity.rejects()).collect()}
    assert len(got) == 602
    held = [r for r in rows if 400 <= r[0] < 600]
    assert sum(got[i]["toxic"] == bool(y) for i, _, y in held) >= 0.97 * len(held)
    assert not got[600]["toxic"] and got[600]["severity"] == got[601]["severity"]
    assert (np.diff(model.cuts) >= 0).all()
    assert all(0 <= r["severity"] <= toxicity.GRADES - 1 for r in got.values())


def test_toxicity_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0), (2, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r["grade"] for r in toxicity.score(docs, model).collect()] == [0, 0]


# ---- op4


def brute_mixture(units, weights):
    """Sources by slot: every node of the tree merges its children by exact deadlines."""
    names = sorted(units, key=lambda s: (-weights[s], s))

    def turns(members, x):
        """The virtual time at which ``members`` have been due x units."""
        due, rate, last = Fraction(0), sum(weights[s] for s in members), Fraction(0)
        for s in sorted(members, key=lambda s: units[s] / weights[s]):
            end = units[s] / weights[s]
            if due + rate * (end - last) >= x:
                break
            due, rate, last = due + rate * (end - last), rate - weights[s], end
        return last + (x - due) / rate

    def merged(members, level):
        if level < 0:
            return [members[0]] * units[members[0]]
        half = 1 << level
        parts = [p for p in (members[:half], members[half:]) if p]
        done = [(turns(p, Fraction(j + 1)), side, s) for side, p in enumerate(parts) for j, s in enumerate(merged(p, level - 1))]
        return [s for _, _, s in sorted(done, key=lambda x: x[:2])]

    return merged(names, (len(names) - 1).bit_length() - 1)


def earliest_deadline_first(a, b, slots):
    """Two tasks of weights a and b, slot by slot: released blocks, the earliest deadline first."""
    out, done = [], [0, 0]
    for t in range(slots):
        ready = [(Fraction((done[i] + 1) * (a + b), w), i) for i, w in enumerate((a, b)) if done[i] * (a + b) // w <= t]
        due, i = min(ready)
        assert due > t
        out.append(i)
        done[i] += 1
    return out


def farthest(order, rows, weights, block_rows):
    """The largest difference of any source from its target in front of any place, in rows."""
    left = dict(rows)
    seen, fair, most = collections.Counter(), collections.Counter(), Fraction(0)
    active = sum(weights[s] for s, n in left.items() if n > 0)
    for s in order:
        rest = Fraction(1)
        while rest and active:
            step = min([rest] + [(rows[x] - fair[x]) * active / weights[x] for x in rows if fair[x] < rows[x]])
            for x in rows:
                if fair[x] < rows[x]:
                    fair[x] += step * weights[x] / active
            active = sum(weights[x] for x in rows if fair[x] < rows[x])
            rest -= step
        seen[s] += 1
        most = max([most, *(abs(seen[x] - fair[x]) for x in rows)])
    return most


@pytest.mark.parametrize("weights", [{"a": 5.0, "b": 1.0, "c": 0.125}, {"a": 1.0, "b": 1.0}, {"a": 1.25, "b": 398.75, "c": 7.0, None: 2.0}])
def test_mixture_matches_exact_deadlines(spark, weights):
    counts = {"a": 200, "b": 161, "c": 7, None: 13}
    rows = [(i, s, "x", 9, 1.5) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, source string, place string, slot int, w double")
    got = mixing.mix(frame, weights, block_rows=12).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows) and all(r["w"] == 1.5 for r in got)
    key = {s: "n" if s is None else "s" + s for s in counts}
    exact = {key[s]: Fraction(weights.get(s, 1.0)) for s in counts}
    unit, a_block = mixing.cut(4, 12)
    assert (unit, a_block) == (4, 3)
    want = brute_mixture({key[s]: -(-n // unit) for s, n in counts.items()}, exact)
    seen = {r["slot"]: key[r["source"]] for r in got}
    assert [seen[t] for t in range(len(want))] == want and len(seen) == len(want)
    assert len({r["place"] for r in got}) == len(got)
    order = [key[r["source"]] for r in sorted(got, key=lambda r: r["place"])]
    assert farthest(order, {key[s]: n for s, n in counts.items()}, exact, 12) < 12


@pytest.mark.parametrize("a,b", [(3, 5), (1, 1), (1, 2000), (14, 3986)])
def test_two_sources_are_served_earliest_deadline_first(spark, a, b):
    sources = spark.createDataFrame([("b", 0, 3000, float(b)), ("a", 1, 3000 * a // b + 1, float(a))], "source string, at int, n long, w double")
    units = sources.selectExpr("source", "explode(sequence(0L, n - 1)) as unit")
    got = {r["slot"]: r["source"] for r in mixing.scheduled(units, sources, 2).collect()}
    want = earliest_deadline_first(b, a, 2500)
    assert [got[t] for t in range(2500)] == ["ba"[i] for i in want]


def test_mixture_of_many_sources(spark):
    n = 3000
    frame = spark.range(3 * n).selectExpr("id as doc_id", f"concat('s', id % {n}) as source")
    weights = {f"s{i}": 1.0 + i % 7 for i in range(n)}
    got = mixing.mix(frame, weights).select("source", "slot", "place").collect()
    assert len({r["place"] for r in got}) == 3 * n and len({r["slot"] for r in got}) == len({(r["source"], r["slot"]) for r in got})


def test_mixture_by_row_counts_stays_near_its_target(spark):
    counts = {"hot": 900, **{f"s{i}": 60 for i in range(19)}}
    rows = [(i, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string")).orderBy("place").collect()
    assert farthest([r["source"] for r in got], counts, {s: Fraction(n**0.5) for s, n in counts.items()}, 32) < 32


def test_mixture_of_nothing_and_of_repeated_rows(spark):
    schema = "doc_id long, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "a")] * 5 + [(None, "b")], schema)).count() == 6
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([(1, "a")], schema), {"a": 0.0})


# ---- op5


def test_archives_round_trip(spark, tmp_path):
    long, other = "é" * 700, "z" * 1500
    pages = [(1, "http://A.example.org/x", long), (2, "http://b.example.org/\r\ny", long), (3, None, None), (4, "u", "short"), (5, "u", "short"), (6, "http://a.example.org/x", "WARC/1.1\r\n\r\n" * 200), (7, "", long), (8, "http://c/", other), (9, "q", ""), (None, "n", long), (8, "http://c/", other)]
    frame = spark.createDataFrame([(*p, "d") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    path = f"file://{tmp_path}/warc"
    warc.write_archives(frame, path, archive_bytes=900)
    got = warc.captures(spark, path).orderBy("capture_order").collect()
    assert len(got) == len(pages)
    for page, _, html in pages:
        data = (html or "").encode()
        for r in (r for r in got if r["page_id"] == page):
            assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
            best = max((p for p, _, h in pages if (h or "") == (html or "") and p is not None), default=None)
            revisit = len(data) >= 1000 and page != best
            assert (r["record_type"], r["refers_to"]) == (("revisit", best) if revisit else ("response", None))
    files = {}
    for name in os.listdir(f"{tmp_path}/warc"):
        if name.startswith("part-"):
            files[name] = open(f"{tmp_path}/warc/{name}", "rb").read()
    assert len(files) > 3
    for r in got:
        record = gzip.decompress(files[r["archive"]][r["offset"] : r["offset"] + r["length"]])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert r["page_id"] is None or b"WARC-Record-ID: <urn:page:%d>\r\n" % r["page_id"] in record
    assert all(sum(r["length"] for r in got if r["archive"] == name) == len(data) for name, data in files.items())
    order = [(r["url_key"], r["timestamp"], r["page_id"] is not None, r["page_id"] or 0) for r in got]
    assert order == sorted(order) and [r["capture_order"] for r in got] == list(range(len(got)))
    assert warc.url_key("http://A.b.org/x?y#z") == "org,b,a)/x?y" and warc.url_key("http://b.org") == "org,b)/"


def test_archives_of_no_pages(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.captures(spark, path).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 3000])
def test_loser_tree_merges(k):
    random.seed(k)
    runs = [sorted(((random.choice("ab"), random.randint(0, 9), i, j), j) for j in range(random.randint(0, 9))) for i in range(k)]
    merged = list(LoserTree([iter(r) for r in runs]))
    assert merged == [j for _, j in sorted(e for r in runs for e in r)]


def test_long_records_take_several_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 100)
    data = ("WARC/1.1\r\n" + "X: y\r\n" * 40 + "Content-Length: 900\r\n\r\n").encode() + bytes(900) + b"\r\n\r\n"
    stored = warc.member(data) + warc.member(data)
    head, block, end = warc.read_record(memoryview(stored), 0)
    assert block == bytes(900) and 2 * end == len(stored) and stored[end - 1] == 0 and gzip.decompress(stored[:end]) == data
    with pytest.raises(ValueError):
        warc.read_record(memoryview(stored[: end - 9]), 0)


def test_ranges_of_the_index_are_bounded(spark):
    names = warc.ARROW_INDEX.names
    rows = []
    for run in range(7):
        entries = sorted((f"k{random.Random(run * 100 + i).randint(0, 30):02}", "t", i) for i in range(40))
        rows += [(u, t, p, "u", "response", None, 1, "d", f"f{run}", 10 * i, 1, i) for i, (u, t, p) in enumerate(entries)]
    frame = spark.createDataFrame(rows, warc.INDEX).repartition(5)
    merged = warc.merge_index(frame, range_entries=50)
    got = [tuple(r[c] for c in ("url_key", "timestamp", "page_id", "archive", "offset")) for r in merged.orderBy("capture_order").collect()]
    assert got == sorted((r[0], r[1], r[2], r[8], r[9]) for r in rows) and "run_place" in names


# ---- op6


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = 64
    lengths = np.minimum(rng.geometric(0.06, 900), capacity)
    counts = collections.Counter(lengths.tolist())
    plan = packing.plan_bins(counts, capacity)
    used = collections.defaultdict(list)
    for length, n in counts.items():
        bins, offsets = plan.place(np.full(n, length), np.arange(n))
        for b, o in zip(bins.tolist(), offsets.tolist()):
            used[b].append((o, length))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    assert len(used) == plan.bins <= -(-int(lengths.sum()) // capacity) + 2


def test_two_for_one_fills_better():
    plan = packing.plan_bins({60: 1, 30: 1, 39: 1, 1: 1, 20: 2}, 100)
    assert plan.bins == 2
    assert packing._two_for(9, np.array([0, 0, 0, 0, 1, 1, 0, 0, 0, 0])) == (5, 4)
    assert packing._two_for(10, np.array([0, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0])) == (5, 4)
    assert packing._two_for(8, np.array([0, 0, 0, 0, 1, 0, 0, 0, 0])) == (0, 0)
    assert packing._two_for(8, np.array([0, 0, 0, 0, 2, 0, 0, 0, 0])) == (4, 4)


def test_packing_matches_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    texts = [None, "", "  ", "Hello, World! don't", "a\u00a0b\u2003c\x1cd\x85e", "e\u0301 \u0301x İ ΑΣ ΑΣ\tΑΣ", "<|endoftext|> x<|startoftext|>y", "x" * 3000, "two\n\nlines\r\nmore", "日本語 text", *["same text"] * 30, "many words of text " * 400]
    frame = spark.createDataFrame([(i, x, 0) for i, x in enumerate(texts)], "doc_id long, text string, length int")
    packed = packing.pack(frame, path, capacity=128, with_ids=True)
    rows = packed.collect()
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in mine for x in r["ids"]] == ids
        assert [r["start"] for r in mine] == list(range(0, len(ids), 128))
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in mine)
    total = sum(r["length"] for r in rows)
    whole = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in whole) == total and max(len(r["ids"]) for r in whole) <= 128
    assert len(whole) <= -(-total // 128) + 1
    assert packing.pack(frame.limit(0), path).count() == 0


# ---- op8


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(1500, 8))
    vectors[200:500] = vectors[200]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(2000, None, "x"), (2100, [0.0] * 8, "x"), (2200, [1.0, None] + [1.0] * 6, "x"), (2300, [float("nan")] * 8, "x"), (2400, [float("inf")] * 8, "x"), (None, [1.0] * 8, "x"), (2500, [1.0], "x"), (100, vectors[100].tolist(), "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = collections.defaultdict(list)
    for r in prefix_forest.nearest(frame, segment_rows=100).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert sorted(got) == list(range(0, 1500, 100))
    hits = total = 0
    for q, found in got.items():
        distance = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        want = sorted((d, i) for i, d in enumerate(distance) if i != q)[:10]
        assert found == sorted(found) and len(found) == 10
        assert all(abs(d - distance[i]) < 1e-12 and i != q for d, i in found)
        hits += len({i for _, i in want} & {i for _, i in found})
        total += 10
    assert hits >= 0.9 * total
    assert [i for _, i in got[300]] == list(range(200, 210))
    few = prefix_forest.nearest(frame.where("vec_id < 5")).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert prefix_forest.nearest(frame.limit(0)).count() == 0


def test_a_search_that_measures_all_is_exact(spark):
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(400, 6))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in prefix_forest.nearest(frame, every=40, k=7, segment_rows=50, segment_keep=None, keep=None, share=prefix_forest.TREES).collect()}
    want = {}
    for q in range(0, 400, 40):
        far = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        want |= {(q, n + 1): int(i) for n, i in enumerate(np.argsort(far, kind="stable")[:7])}
    assert got == want


# ---- op10


def test_shards_grow_only_into_the_new_one(spark):
    texts = [None, "", "é", "a" * 1000, *[f"t{i}" for i in range(400)]]
    frame = spark.createDataFrame([(i, x, "s", 3) for i, x in enumerate(texts)] + [(7, texts[7], "s", 3), (None, "n", "s", 3)], "doc_id long, text string, shard string, size int")
    for n in (1, 4, 8, 12):
        rows = sharding.shard(frame, sharding.even_tree(n), sharding.even_tree(n + 1, laid=n)).collect()
        assert len(rows) == len(texts) + 2
        assert all(r["grown_shard"] in (r["shard"], n) for r in rows)
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            text = texts[r["doc_id"]] if r["doc_id"] is not None else "n"
            assert r["size"] == len((text or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text or "").encode())
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shard(frame.limit(0), sharding.even_tree(8)).count() == 0


def test_any_number_of_shards_grows_by_one(spark):
    """From n to n + 1 for n of 1 to 20, all joined after the first eight, or none laid before: rows move only into the new one."""
    frame = spark.range(3000).selectExpr("cast(id as string) as key")
    for laid in (1, 8):
        sizes = range(laid, 21)
        held = frame
        for n in [*sizes, 21]:
            held = sharding.descend(held, F.col("key"), sharding.even_tree(n, laid=laid), f"at{n}")
        rows = held.select(*[F.col(f"at{n}.shard").alias(f"s{n}") for n in [*sizes, 21]]).collect()
        for n in sizes:
            assert all(r[f"s{n + 1}"] in (r[f"s{n}"], n) for r in rows)
            assert 0.5 < sum(r[f"s{n + 1}"] == n for r in rows) * (n + 1) / 3000 < 1.5


def brute_descent(key, tree):
    """Region, rack and shard with the least draw among the children of each node, from plain Python."""
    node, way = "", []
    for depth in (1, 2, 3):
        weights = collections.Counter()
        for x in tree:
            if x.weight > 0 and "/".join(map(str, x.path(depth - 1))) == node:
                weights["/".join(map(str, x.path(depth)))] += x.weight
        def far(child):
            u = int(hashlib.md5(f"{key}/{child}".encode()).hexdigest()[:13], 16)
            return -math.log((u + 0.5) / 16**13) / weights[child]
        node = min(sorted(weights), key=far)
        way.append(int(node.rpartition("/")[2]))
    return tuple(way)


def test_descent_matches_plain_draws(spark):
    tree = [sharding.Leaf(0, 0, 0, 2.0), sharding.Leaf(0, 1, 1, 1.0), sharding.Leaf(1, 2, 2, 1.0), sharding.Leaf(1, 2, 3, 0.0), sharding.Leaf(1, 3, 10, 0.5)]
    frame = spark.range(300).selectExpr("id as doc_id", "'' as text")
    got = {r["doc_id"]: (r["region"], r["rack"], r["shard"]) for r in sharding.shard(frame, tree).collect()}
    assert got == {k: brute_descent(k, tree) for k in range(300)}
    with pytest.raises(ValueError):
        sharding.shard(frame, [])


def test_weights_move_rows_only_into_changed_subtrees(spark):
    tree = [sharding.Leaf(0, 0, 0, 2.0), sharding.Leaf(0, 1, 1, 1.0), sharding.Leaf(1, 2, 2, 1.0), sharding.Leaf(1, 2, 3, 0.0), sharding.Leaf(1, 3, 4, 1.0)]
    grown = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 2 else x.weight) for x in tree] + [sharding.Leaf(1, 2, 5, 1.0)]
    frame = spark.range(4000).selectExpr("id as doc_id", "'' as text")
    now, later = ({r["doc_id"]: (r["region"], r["rack"], r["shard"]) for r in sharding.shard(frame, x).collect()} for x in (tree, grown))
    share = collections.Counter(s for _, _, s in now.values())
    assert 0.36 < share[0] / 4000 < 0.44 and share[3] == 0
    later_share = collections.Counter(s for _, _, s in later.values())
    assert abs(later_share[2] / 4000 - 3 / 8) < 0.03 and abs(later_share[5] / 4000 - 1 / 8) < 0.03
    for k, (region, rack, shard) in later.items():
        was = now[k]
        assert was == (region, rack, shard) or (was[0] != region and region == 1) or (was[0] == region == 1 and rack == 2)
