"""The Merkle manifest against a plain tree in memory."""

import hashlib
import zlib

import pytest

from dendrovox.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    n = None if row["n_chars"] is None else row["n_chars"] + more
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], n, row["text"])))


def plain_tree(hashes, fanout):
    """The root and, for each leaf, (left, right) of every level."""
    sides, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for k, i in enumerate(at):
            run = i - i % fanout
            sides[k].append(("".join(hashes[run:i]), "".join(hashes[i + 1 : run + fanout])))
        hashes = [digest("".join(hashes[i : i + fanout])) for i in range(0, len(hashes), fanout)]
        at = [i // fanout for i in at]
    return hashes[0], sides


def plain_manifest(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault("" if r["lang"] is None else "s" + r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    names, trees = sorted(groups, key=lambda g: g.encode()), {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = plain_tree([x[2] for x in groups[g]], fanout)
    root, crowns = plain_tree([trees[g][0] for g in names], fanout)
    out = []
    for g, crown in zip(names, crowns):
        for (_, _, leaf, r), sides in zip(groups[g], trees[g][1]):
            way = sides + crown
            h = leaf_of(r, 1) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 else leaf
            for left, right in way:
                h = digest(left + h + right)
            out.append((r["doc_id"], leaf, trees[g][0], root, digest("".join(a + b for a, b in way)), h, h == root))
    return sorted(out, key=str)


def table(spark, n):
    rows = [(i * 3 % 1001, f"s{i % 4}" if i % 9 else None, [None, "en", "é", "", "zz"][i % 5 if i % 3 else 1], None if i % 11 == 0 else i, None if i % 13 == 0 else "wörd " * (i % 4)) for i in range(n)]
    rows += [(None, None, None, None, None), (5, "s", "en", 1, "x"), (5, "s", "en", 1, "x"), (5, "s", "en", 2, "y"), (2**62, "s", "en", 2**63 - 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)


@pytest.mark.parametrize("fanout, deep, n", [(2, 2, 150), (3, 1, 150), (2, 9, 150), (2, 1, 0), (4, 2, 70)])
def test_manifest_matches_a_plain_tree(spark, fanout, deep, n):
    frame = table(spark, n)
    got = sorted((tuple(r) for r in merkle.manifest(frame, cut=merkle.Blocks(fanout, deep)).collect()), key=str)
    assert got == plain_manifest(frame.collect(), fanout)


def test_many_groups_and_one_leaf(spark):
    frame = spark.createDataFrame([(i, "s", f"g{i % 37}", i, "t") for i in range(90)], "doc_id long, source string, lang string, n_chars long, text string")
    got = sorted((tuple(r) for r in merkle.manifest(frame, cut=merkle.Blocks(2, 1)).collect()), key=str)
    assert got == plain_manifest(frame.collect(), 2)
    lone = merkle.manifest(frame.where("doc_id = 1")).first()
    assert lone["leaf"] == lone["subroot"] == lone["root"] == lone["folded_root"] and lone["proof_sha256"] == digest("") and lone["verified"]


def test_no_rows_no_manifest(spark):
    assert merkle.manifest(table(spark, 0).where("false")).collect() == []


def test_a_bent_copy_is_told_from_any_leaf(spark):
    rows = merkle.manifest(table(spark, 60), cut=merkle.Blocks(2, 2)).collect()
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        assert r["verified"] or hit
    assert sum(not r["verified"] for r in rows) > 3
