"""Sets cut into fragments of one global order: candidates, partial overlaps and their components.

A set is the 64-bit hashes of a text's runs of words in ascending order, an order that all sets share.
``segments`` cuts it into ``FRAGMENTS`` even ranges; how much two sets share is counted in each fragment
apart and summed for the pair, so no row holds more than a fragment of a set and no pair carries a set
through a shuffle. Which pairs are counted comes from keys: two sets with a key in common may be linked,
and the caller answers for every linked pair having one. Components need far fewer pairs than a bucket
of one key has: members meet the bucket's leader first, and what is left to tell apart meets on its
rarest members.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from dendrovox.plans.components import connected_components
from dendrovox.plans.durable import materialize

FRAGMENTS = 16
#: Bits of a set's parity map.
MAP_BITS = 1024
#: Rows of one key that a task may hold; a key with more is dealt to several tasks.
HOT_ROWS = 1_000_000
#: One of this many documents is looked at to find such keys.
SAMPLED = 64
LONGEST = 16
#: Rows of a bucket whose pairs are looked at one by one; larger ones take the way over rare members. Both ways find all links.
SMALL = 16
#: Rows of (doc, digest) that are sent to every task: 40 MB at most.
SENT_ROWS = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but blanks and the controls 9 to 13, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


POWERS = np.asarray([pow(0x9E3779B97F4A7C15, n, 1 << 64) for n in range(LONGEST)], np.uint64)


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of ``width`` words (of fewer words: of them all), sorted."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += h[i : i + n] * POWERS[i]
    total = mixed(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def same_words(words: list[bytes]) -> bytes | None:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """``MAP_BITS`` bits as longs: each member turns one over, so maps differ in no more bits than sets in members."""
    at = (shingles >> np.uint64(64 - (MAP_BITS.bit_length() - 1))).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=MAP_BITS) & 1).astype(np.uint8)).view(np.int64)


def segments(docs: DataFrame, width: int, fragments: int = FRAGMENTS) -> DataFrame:
    """(doc, f, seg): the members of each fragment, for rows (doc, text, same); rows of other words than ``same`` are left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, at, parts = [], [], []
            for key, text, same in zip(*(batch.column(i) for i in range(3))):
                words = words_of(text.as_py())
                if not words or same_words(words) != same.as_py():
                    continue
                shingles = shingle_set(words, width)
                f = ((shingles >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
                ends = np.searchsorted(f, np.arange(fragments + 1))
                for i in np.flatnonzero(np.diff(ends)):
                    doc.append(key.as_py())
                    at.append(i)
                    parts.append(shingles[ends[i] : ends[i + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["doc", "f", "seg"])

    return docs.mapInArrow(cut, "doc long, f int, seg array<long>")


def segment_tables(docs: DataFrame, width: int, path: str) -> Callable[[DataFrame], DataFrame]:
    """A function that cuts the texts of given rows (doc, same, copies) of ``docs`` (doc, text) into segments, a written table a call.

    Only documents that have several rows are cut more than once, and then their segments are made one again.
    """
    calls = itertools.count()

    def cut_of(wanted: DataFrame) -> DataFrame:
        table, wanted = f"{path}/segments-{next(calls)}", materialize(wanted)
        once, often = wanted.where("copies = 1").drop("copies"), wanted.where("copies > 1").drop("copies")
        segments(docs.join(near_rows(once), "doc"), width).write.parquet(table)
        if not often.isEmpty():
            segments(docs.join(near_rows(often), "doc"), width).dropDuplicates(["doc", "f"]).write.mode("append").parquet(table)
        return docs.sparkSession.read.parquet(table)

    return cut_of


def possible(percent: int) -> Column:
    """Whether sizes (un, vn) and parity maps (us, vs) leave the threshold possible: what they rule out is never linked."""
    apart = sum((F.bit_count(F.get("us", F.lit(i)).bitwiseXOR(F.get("vs", F.lit(i)))) for i in range(MAP_BITS // 64)), F.lit(0))
    return (100 * F.least("un", "vn") >= percent * F.greatest("un", "vn")) & ((100 + percent) * apart <= (100 - percent) * (F.col("un") + F.col("vn")))


def linked(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of ``pairs`` (u, v, un, vn) whose sets reach ``percent``: overlaps counted by fragment, summed by pair.

    The segments of v travel to those of u, so u should be the one with more pairs. Other segments stay where they are.
    """
    pairs = materialize(pairs.select("u", "v", "un", "vn"))

    def of(x: str, seg: str) -> DataFrame:
        return cut.join(near_rows(pairs.select(F.col(x).alias("doc")).distinct()), "doc", "left_semi").select(F.col("doc").alias(x), "f", F.col("seg").alias(seg))

    met = pairs.join(of("v", "b"), "v").join(of("u", "a"), ["u", "f"])
    partial = met.select("u", "v", "un", "vn", F.size(F.array_intersect("a", "b")).cast("long").alias("part"))
    both = partial.groupBy("u", "v", "un", "vn").agg(F.sum("part").alias("both"))
    return both.where(100 * F.col("both") >= percent * (F.col("un") + F.col("vn") - F.col("both"))).select("u", "v")


def crowded(keyed: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (key, doc, rows) whose key some other document has too; rows: about how many the key has.

    A key of more than ``hot_rows`` rows is dealt to several tasks, which count each by themselves.
    """
    seen = keyed.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0).groupBy("key").agg((F.count(F.lit(1)) * SAMPLED).alias("rows"))
    # At most one key for every ``hot_rows`` rows of the table; AQE decides by size how they meet.
    hot = seen.where(F.col("rows") > hot_rows).select("key", F.ceil(F.col("rows") / hot_rows).cast("int").alias("tasks"))
    dealt = keyed.join(hot, "key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc", F.lit(7)), F.col("tasks")), F.lit(0))) if not hot.isEmpty() else keyed.withColumns({"tasks": F.lit(None).cast("int"), "salt": F.lit(0)})
    group = Window.partitionBy("key", "salt")
    many = F.col("tasks").isNotNull() | (F.min("doc").over(group) != F.max("doc").over(group))
    rows = F.count(F.lit(1)).over(group) * F.coalesce("tasks", F.lit(1))
    return dealt.withColumns({"many": many, "rows": rows}).where("many").select("key", "doc", "rows")


def on_rare_members(pool: DataFrame, cut: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v, un, vn) of ``pool`` (doc, component) in two components that may reach ``percent``.

    Members are ordered by how few documents have them. Two linked sets share one among the first
    n - ceil(n percent / 100) + 1 of each; what comes after the places where they meet bounds how
    much they can share.
    """
    words = cut.join(pool, "doc").select("doc", "component", F.explode("seg").alias("s"))
    seen = words.groupBy("s").agg(F.count(F.lit(1)).alias("seen"))
    ordered = words.join(seen.where("seen > 1"), "s").groupBy("doc", "component").agg(F.array_sort(F.collect_list(F.struct("seen", "s"))).alias("common")).join(facts, "doc")
    # Members that no other document has come first in the order and can match nothing.
    alone = F.col("n") - F.size("common")
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    prefix = ordered.withColumns({"alone": alone, "room": room.cast("int")}).where("room > 0").select("doc", "component", "n", "bits", "alone", F.posexplode(F.slice("common", F.lit(1), F.col("room"))).alias("i", "word"))
    prefix = materialize(prefix.select("doc", "component", "n", "bits", (F.col("alone") + F.col("i")).alias("i"), F.col("word.s").alias("s")))
    u, v = (prefix.select(F.col("s").alias(f"{x}w"), *[F.col(c).alias(n) for c, n in (("doc", x), ("component", f"{x}c"), ("n", f"{x}n"), ("i", f"{x}i"), ("bits", f"{x}s"))]) for x in "uv")
    rest = 1 + F.least(F.col("un") - F.col("ui") - 1, F.col("vn") - F.col("vi") - 1)
    enough = (100 + percent) * rest >= percent * (F.col("un") + F.col("vn"))
    met = u.join(v, (F.col("uw") == F.col("vw")) & (F.col("u") < F.col("v")) & (F.col("uc") != F.col("vc")) & enough & possible(percent))
    return met.select("u", "v", "un", "vn").distinct()


def near_rows(wanted: DataFrame) -> DataFrame:
    """``wanted`` for a join with the texts: sent to every task while it is small, so that no text is shuffled."""
    return F.broadcast(wanted) if wanted.count() <= SENT_ROWS else wanted


def within(buckets: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v, un, vn) that may be linked of small buckets: rows (key, doc, component) of at most ``SMALL`` a key."""
    u, v = (buckets.select("key", F.col("doc").alias(x), F.col("component").alias(f"{x}c")) for x in "uv")
    met = u.join(v, "key").where("u < v and uc <> vc").select("u", "v").distinct()
    u_facts, v_facts = (facts.select(F.col("doc").alias(x), F.col("n").alias(f"{x}n"), F.col("bits").alias(f"{x}s")) for x in "uv")
    return met.join(u_facts, "u").join(v_facts, "v").where(possible(percent)).select("u", "v", "un", "vn")


def components(keyed: DataFrame, facts: DataFrame, cut_of: Callable[[DataFrame], DataFrame], percent: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component) of all documents that are linked with another.

    ``facts``: (doc, n, bits), one row a document, all sets different; ``keyed``: (key, doc), linked
    documents share a key. ``cut_of``: the segments of given documents (doc), as a written table.
    """
    counted = materialize(crowded(keyed, hot_rows))
    involved = materialize(counted.select("doc").distinct())
    facts = materialize(facts.join(near_rows(involved), "doc", "left_semi"))
    scores = counted.groupBy("doc").agg(F.sum("rows").alias("score"))
    # The text that copies were made from shares more keys with them than they share with each other.
    leads = counted.join(scores, "doc").groupBy("key").agg(F.max(F.struct("score", "doc")).alias("lead")).select("key", F.col("lead.doc").alias("leader"))
    led = materialize(counted.join(leads, "key").where("doc <> leader").select("key", "doc", "leader", "rows"))

    u_facts, v_facts = (facts.select(F.col("doc").alias(x), F.col("n").alias(f"{x}n"), F.col("bits").alias(f"{x}s")) for x in "uv")
    met = led.groupBy(F.least("doc", "leader").alias("low"), F.greatest("doc", "leader").alias("high")).agg(F.count(F.lit(1)).alias("votes"), F.max("leader").alias("u"))
    met = met.select("u", F.when(F.col("u") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("v"), "votes")
    votes = materialize(met.join(u_facts, "u").join(v_facts, "v").where(possible(percent)).select("u", "v", "un", "vn", "votes"))
    ends = votes.select(F.col("u").alias("doc"), "*").union(votes.select(F.col("v").alias("doc"), "*"))
    cut = cut_of(ends.select("doc").distinct())

    best = F.max(F.struct("votes", F.xxhash64("u", "v").alias("draw"), "u", "v", "un", "vn")).alias("best")
    first = materialize(ends.groupBy("doc").agg(best).select("best.u", "best.v", "best.un", "best.vn").distinct())
    links = materialize(linked(first, cut, percent))
    parts = connected_components(links)

    def apart(pairs: DataFrame) -> DataFrame:
        u_part, v_part = (parts.select(F.col("node").alias(x), F.col("component").alias(f"{x}c")) for x in "uv")
        return pairs.join(u_part, "u", "left").join(v_part, "v", "left").where("coalesce(uc, u) <> coalesce(vc, v)").drop("uc", "vc")

    found = materialize(linked(apart(votes.drop("votes").join(first.select("u", "v"), ["u", "v"], "left_anti")), cut, percent))
    if not found.isEmpty():
        links = links.union(found)
        parts = connected_components(links)

    # What is left: pairs of a bucket, neither the leader, in two components. Those of small buckets
    # are looked at one by one. Documents of large ones meet on their rarest members, of which any
    # linked pair shares one.
    placed = led.join(parts.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    split = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    placed = materialize(placed.join(split, "key").select("key", "doc", "component", "rows"))
    few = materialize(within(placed.where(F.col("rows") <= SMALL), facts, percent))
    pool = materialize(placed.where(F.col("rows") > SMALL).select("doc", "component").distinct())
    more = cut_of(few.select(F.col("u").alias("doc")).union(few.select("v")).union(pool.select("doc")).distinct())
    found = materialize(linked(few, more, percent).union(linked(on_rare_members(pool, more, facts, percent), more, percent)))
    return parts if found.isEmpty() else connected_components(links.union(found))


def by_class(prints: DataFrame, percent: int, cut_of: Callable[[DataFrame], DataFrame], path: str, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``prints`` (doc, n, class, same, keys, bits), written before.

    Rows of one class have equal sets; its least document stands for it. Of a document with several
    texts that leads classes of its own, the text with the least class and digest is held against
    others, so the result does not depend on the order of rows. ``cut_of``: the segments of (doc, same, copies).
    """
    spark = prints.sparkSession
    classes = materialize(prints.where("class is not null and doc is not null").groupBy("class").agg(F.min("doc").alias("head")))
    leading = prints.select("doc", "class", "same").join(classes, "class").where("doc = head")
    counted = leading.groupBy("doc", "class", "same").agg(F.count(F.lit(1)).alias("copies"))
    heads = materialize(counted.groupBy("doc").agg(F.min(F.struct("class", "same", "copies")).alias("p"), F.sum("copies").alias("copies")).select("doc", "p.same", "copies"))
    near = near_rows(heads.select("doc", "same"))
    prints.join(near, ["doc", "same"]).select("doc", "n", "bits").dropDuplicates(["doc"]).write.parquet(f"{path}/facts")
    keyed = prints.select("doc", "same", "keys").join(near, ["doc", "same"]).select("doc", F.explode("keys").alias("key"))
    parts = components(keyed, spark.read.parquet(f"{path}/facts"), lambda docs: cut_of(docs.join(heads, "doc")), percent, hot_rows)
    resolved = classes.join(parts.select(F.col("node").alias("head"), "component"), "head", "left").select("class", F.coalesce("component", "head").alias("component"))
    out = prints.select("doc", "n", "class").join(resolved, "class", "left").withColumn("component_id", F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id")
