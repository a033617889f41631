"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

Only lengths decide a packing, and there are at most ``capacity`` of them, so the plan is made from
the histogram of lengths: a bin is filled greedily with the longest pieces that fit, then its
smallest piece gives way to two unpacked ones that fill the widened gap more tightly, and the bin is
repeated while its lengths last. Pieces are numbered within their length across the cluster, and
piece r of a length goes to the place that the plan gives that number.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendrovox.operators.ranking import ranked
from dendrovox.plans.durable import materialize

if TYPE_CHECKING:
    from tokenizers import Tokenizer

END_ID = 1
CACHE_WORDS = 1_000_000
RANK_BUCKETS = 256
RUN_ROWS = 4096
#: Rows whose texts are held as Python strings at a time.
ROWS_AT_ONCE = 1024


def _byte_letters() -> dict[int, str]:
    """The public alphabet of byte-level tokenizers: a byte that prints is itself, the others the letters from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters() | {32: " "}


class WordIds:
    """Ids, as little-endian bytes, of words between spaces and line feeds.

    For a tokenizer that drops spaces and line feeds a text's ids are its words' ids in order, so
    each word is encoded once. New words are encoded many at a time, with a NUL between them whose
    id marks where a word ends. Words of plain letters go straight to the tokenizer's model, as its
    normalization does no more than lower-case them; there the ids that end a piece tell the words
    apart. The cache starts anew when it is full.
    """

    MARK = "\0"
    AT_ONCE = 256
    #: Letters that normalization only lower-cases, then signs that make one piece.
    PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]*")
    SIGNS = re.compile(r"[.,;:!?]+")
    PROBES = ("Hello,", "ÉTÉ!!", "straße", "thanerand.", "x", "Añb;:")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.known: dict[str, bytes] = {"": b""}
        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.mark = self._encode(self.MARK)
        self.drops_blanks = len(self.mark) == 1 and self._encode("ab\n \0 b") == self._encode("ab") + self.mark + self._encode("b")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.plain = self.drops_blanks and self._spelled_right()

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pieces(self, words: list[str]) -> str:
        """Plain words as the model's own alphabet spells them, letters and signs apart."""
        return self.SIGNS.sub(r" \g<0>", " ".join(words)).lower().encode().decode("latin-1").translate(BYTE_LETTERS)

    def _spelled_right(self) -> bool:
        self._add_plain([list(self.PROBES)])
        right = all(self.known.pop(x) == np.asarray(self._encode(x), "<u4").tobytes() for x in self.PROBES)
        return right and set(self.known) == {""}

    def _cut(self, group: list[str], data: bytes, ends: list[int], gap: int) -> None:
        self.known.update(zip(group, [data[i:j] for i, j in zip([0, *(x + gap for x in ends)], ends, strict=False)], strict=True))

    def _add_plain(self, groups: list[list[str]]) -> None:
        for group, e in zip(groups, self.bare.encode_batch_fast(list(map(self._pieces, groups)), add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            last = np.cumsum([1 if w[-1].isalpha() else 2 for w in group]) - 1
            places = np.flatnonzero(self.ends[ids])
            self._cut(group, ids.tobytes(), (4 * (places[np.minimum(last, len(places) - 1)] + 1)).tolist(), 0)

    def _add(self, groups: list[list[str]]) -> None:
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(list(map(f" {self.MARK} ".join, groups)), add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            self._cut(group, ids.tobytes(), [*(4 * np.flatnonzero(ids == self.mark[0])).tolist(), 4 * len(ids)], 4)

    def learn(self, words: list[str]) -> None:
        plain = list(filter(self.PLAIN.fullmatch, words)) if self.plain else []
        rest = set(words).difference(plain)
        marked = [w for w in rest if self.MARK in w]
        others = list(rest.difference(marked))
        self.known.update((w, np.asarray(self._encode(w), "<u4").tobytes()) for w in marked)
        for words, add in ((plain, self._add_plain), (others, self._add)):
            add([words[i : i + self.AT_ONCE] for i in range(0, len(words), self.AT_ONCE)])

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        if not self.drops_blanks:
            for x in texts:
                yield np.asarray(self._encode(x), "<u4").tobytes()
            return
        for at in range(0, len(texts), 128):
            split = [x.replace("\n", " ").split(" ") for x in texts[at : at + 128]]
            words = set().union(*split)
            if len(self.known) + len(words) > CACHE_WORDS:
                self.known = {"": b""}
            self.learn(list(words.difference(self.known)))
            for words in split:
                yield b"".join(map(self.known.__getitem__, words))


def cut_pieces(df: DataFrame, tokenizer: str, capacity: int = 4096, key: str = "doc_id", text: str = "text", with_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32[, ids], *carry); a null text counts as an empty one.

    A document is its ids and one end id. Only documents of more than ``capacity`` ids are cut.
    """
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            rows: list[list] = [[], [], [], [], [], []]
            origin: list[int] = []
            keys = batch.column(0).to_pylist()
            for i, (k, body) in enumerate(zip(keys, words.ids([x or "" for x in batch.column(1).to_pylist()]), strict=True)):
                body += end
                for piece, at in enumerate(range(0, len(body), 4 * capacity)):
                    ids = body[at : at + 4 * capacity]
                    origin.append(i)
                    for column, value in zip(rows, (k, piece, at // 4, len(ids) // 4, zlib.crc32(ids), np.frombuffer(ids, "<i4") if with_ids else None), strict=True):
                        column.append(value)
            arrays = [pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[2:5]]]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(rows[5], pa.list_(pa.int32())))
                names.append("ids")
            taken = pa.array(origin, pa.int64())
            arrays += [batch.column(2 + i).take(taken) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *carry])

    schema = f"{key} {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    schema += "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in carry)
    return df.select(key, text, *carry).mapInArrow(cut, schema)


@dataclass(frozen=True)
class Plan:
    """Pieces ``first`` up to the next entry's of ``length``: ``use`` of them a bin, from ``offset``."""

    key: np.ndarray
    first: np.ndarray
    use: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) + rank, "right") - 1
        n = rank - self.first[at]
        return self.bin[at] + n // self.use[at], self.offset[at] + n % self.use[at] * length


def _below(free: np.ndarray) -> np.ndarray:
    """For each x, the largest free length of at most x (0: none)."""
    return np.maximum.accumulate(np.where(free > 0, np.arange(len(free)), 0))


def _two_for(room: int, free: np.ndarray) -> tuple[int, int]:
    """Two free lengths that fill ``room`` best, the longer first; (0, 0): none."""
    below = _below(free)
    a = np.flatnonzero(free[: room + 1] > 0)
    if not len(a):
        return 0, 0
    b = below[room - a]
    b = np.where((b == a) & (free[a] < 2), below[np.maximum(np.minimum(room - a, a - 1), 0)], b)
    total = np.where(b > 0, a + b, 0)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(max(a[best], b[best])), int(min(a[best], b[best]))) if total[best] else (0, 0)


def plan_bins(counts: dict[int, int], capacity: int) -> Plan:
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        free[length] = n
    given = np.zeros(capacity + 1, np.int64)
    entries: list[tuple[int, int, int, int, int]] = []
    bins = 0
    while free.any():
        below, use, gap, top = _below(free), {}, capacity, capacity
        while gap and (length := int(below[min(gap, top)])):
            use[length] = int(min(gap // length, free[length]))
            gap, top = gap - use[length] * length, length - 1
        smallest = min(use)
        if gap:
            left = free.copy()
            for length, n in use.items():
                left[length] -= n
            two = _two_for(gap + smallest, left)
            if sum(two) > smallest:
                use[smallest] -= 1
                for length in two:
                    use[length] = use.get(length, 0) + 1
        use = {k: n for k, n in sorted(use.items(), reverse=True) if n}
        times = min(int(free[k]) // n for k, n in use.items())
        offset = 0
        for length, n in use.items():
            entries.append((length, int(given[length]), n, bins, offset))
            given[length] += n * times
            free[length] -= n * times
            offset += n * length
        bins += times
    entries.sort()
    table = np.asarray(entries, np.int64).reshape(-1, 5)
    return Plan((table[:, 0] << 48) + table[:, 1], table[:, 1], table[:, 2], table[:, 3], table[:, 4], bins)


def in_file_order(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text of ``df``, read from Parquet that Spark wrote, with _file and _line: the order its rows were written in. A file of any other name is an error."""
    meta = df.metadataColumn("_metadata")
    name = F.element_at(F.split(meta["file_path"], "/"), -1)
    part, more = (F.regexp_extract(name, x, 1).try_cast("long") for x in (r"^part-(\d+)", r"-c(\d+)\."))
    part = F.coalesce(part, F.raise_error(F.concat(F.lit("not a file that Spark wrote in an order: "), name)).cast("long"))
    more = F.coalesce(more, F.lit(0).cast("long"))
    return df.select(key, text, (part * 1_000_000 + more).alias("_file"), meta["row_index"].cast("long").alias("_line"))


def pack(df: DataFrame, tokenizer: str, capacity: int = 4096, key: str = "doc_id", text: str = "text", with_ids: bool = False, ordered: bool = False) -> DataFrame:
    """Every piece of every document with sequence_id and offset; offsets of a sequence have no gap.

    The driver sees one count for each of at most ``capacity`` lengths and sends back one plan of
    that order of size. Repeated rows are packed as often as they come, null keys like others, null
    texts as empty ones; other columns, whatever their names, are left out; no rows, no sequences.
    With ``ordered``, each run of ``RUN_ROWS`` pieces in the order of ``_file`` and ``_line`` (see
    ``in_file_order``) is packed by itself, and sequences are numbered by their first piece.
    """
    carry = ("_file", "_line") if ordered else ()
    pieces = materialize(cut_pieces(df, tokenizer, capacity, key, text, with_ids, carry))
    if ordered:
        return _pack_runs(pieces, capacity, key)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = df.sparkSession.sparkContext.broadcast(plan_bins(counts, capacity))
    numbered = ranked(pieces, ["length"], F.pmod(F.xxhash64(key, "piece"), F.lit(RANK_BUCKETS)), [F.col(key), F.col("piece")], "_rank")
    order = [c for c in numbered.columns if c != "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            bins, offsets = plan.value.place(batch.column("length").to_numpy(zero_copy_only=False), rank)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in order], pa.array(bins), pa.array(offsets)], names=[*order, "sequence_id", "offset"])

    types = {f.name: f.dataType.simpleString() for f in numbered.schema}
    return numbered.mapInArrow(place, ", ".join(f"{c} {types[c]}" for c in order) + ", sequence_id long, offset long")


def _pack_runs(pieces: DataFrame, capacity: int, key: str) -> DataFrame:
    """``pieces`` with sequence_id and offset; a sequence holds pieces of one run only."""
    bucket = F.struct("_file", F.expr(f"_line div {RUN_ROWS}").alias("part"))
    numbered = ranked(pieces.withColumn("_all", F.lit(0)), ["_all"], bucket, [F.col("_line"), F.col(key), F.col("piece")], "_at")
    numbered = numbered.withColumn("_run", F.expr(f"_at div {RUN_ROWS}")).drop("_all", "_file", "_line")
    names = numbered.columns

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at").select(names)
        length = table.column("length").to_numpy()
        kinds, which, counts = np.unique(length, return_inverse=True, return_counts=True)
        rank = np.empty(len(length), np.int64)
        by_kind = np.argsort(which, kind="stable")
        rank[by_kind] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
        bins, offsets = plan_bins(dict(zip(kinds.tolist(), counts.tolist())), capacity).place(length, rank)
        _, first, again = np.unique(bins, return_index=True, return_inverse=True)
        number = np.argsort(np.argsort(first))[again]
        return table.append_column("_bin", pa.array(number.astype(np.int64))).append_column("offset", pa.array(offsets.astype(np.int64)))

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema)
    packed = materialize(numbered.groupBy("_run").applyInArrow(place, f"{types}, _bin long, offset long"))
    before = Window.partitionBy().orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    base = packed.groupBy("_run").agg((F.max("_bin") + 1).alias("_n")).select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    out = [c for c in pieces.columns if c not in ("_file", "_line")]
    return packed.join(base, "_run").select(*out, (F.col("_base") + F.col("_bin")).alias("sequence_id"), "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from ``pack(..., with_ids=True)``; at most ``capacity`` ids a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
