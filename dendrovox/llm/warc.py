"""WARC archives: written with revisit records, read back, and indexed by an external merge.

Every record is a gzip member of its own, so the offset and length that the index states are enough
to read it. Members are gathered into archives of a bounded number of bytes and written by Spark's
text writer, one archive a row, so any Hadoop file system holds them and a lost task writes its files
anew: a member ends in a zero byte (the high byte of a length below 16 MiB; longer records take
several members), and that byte is the line separator. Every archive yields a run of index entries
sorted by URL key and timestamp. Runs are dealt out by ranges of (URL key, timestamp, page), of a
bounded number of entries each, and a range merges its slices of the runs with a loser tree, so the
ranges in order are one sorted index of all captures.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendrovox.plans.durable import materialize, scratch_path

END = "\r\n\r\n"
EPOCH = 1577836800
LEAST_REVISIT_BYTES = 1000
#: Bytes of an archive (more only where one record has more) and plain bytes of a member.
ARCHIVE_BYTES = 32 << 20
MEMBER_BYTES = 8 << 20
#: Entries of a range of the index: what one task merges.
RANGE_ENTRIES = 100_000
INDEX = "url_key string, timestamp string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long, run_place int"
HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
ID = re.compile(r"<urn:page:(-?\d+)>")


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _page(value: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), value.cast("string"), F.lit(">"))


def records(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One column ``value``: the WARC record of each row.

    Of rows with equal payloads of at least 1000 bytes the one with the largest page is the response
    and the others revisit it (repeated rows of that page are all responses). A null payload is
    empty, a null URL has no WARC-Target-URI, a null page has no WARC-Record-ID and revisits whenever
    its payload has a keeper. Other columns, whatever their names, are left out; without pages there
    are no archives.
    """
    rows = pages.select(F.col(page).cast("long").alias("page"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload"), "digest": F.sha1(F.col("payload").cast("binary"))})
    # Only who revisits whom is joined to the payloads, by page, so copies of a page are no hot key there.
    large = rows.where(F.col("bytes") >= LEAST_REVISIT_BYTES).select("page", "digest")
    keepers = large.groupBy("digest").agg(F.max("page").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null").drop("n")
    path = scratch_path(pages.sparkSession, "revisits")
    large.distinct().join(keepers, "digest").where("not (page <=> keeper)").select(F.col("page").alias("again"), F.col("digest").alias("same"), "keeper").write.parquet(path)
    revisits = pages.sparkSession.read.parquet(path)
    rows = rows.join(revisits, F.col("page").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("same")), "left")
    revisit = F.col("keeper").isNotNull()
    moment = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page", F.lit(0)), F.lit(1_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            _line("WARC-Record-ID", _page(F.col("page"))),
            _line("WARC-Target-URI", F.translate("url", "\r\n", "  ")),
            _line("WARC-Date", moment),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            _line("WARC-Refers-To", F.when(revisit, _page(F.col("keeper")))),
            _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            _line("Content-Type", F.lit("application/http;msgtype=response")),
            F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
        ).alias("value")
    )


def member(data: bytes) -> bytes:
    """``data`` as gzip members of at most ``MEMBER_BYTES``, each with a last byte of 0."""
    out = []
    for at in range(0, len(data), MEMBER_BYTES):
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        out += [packer.compress(data[at : at + MEMBER_BYTES]), packer.flush()]
    return b"".join(out)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, **columns: str) -> None:
    """Write archives of about ``archive_bytes`` below ``path``: a gzip member for each record."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], names=["archive"])

        for batch in batches:
            for value in batch.column(0):
                data = member(value.as_buffer().to_pybytes() + END.encode())
                if parts and size + len(data) > archive_bytes:
                    yield full()
                    parts, size = [], 0
                parts.append(data)
                size += len(data)
        if parts:
            yield full()

    archives = records(pages, **columns).mapInArrow(gather, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query: captures of a site sort together."""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    host, slash, path = re.match(r"([^/?#]*)(/?)([^#]*)", rest).groups()
    return ",".join(reversed(host.lower().split("."))) + ")" + (slash + path or "/")


def _inflated(data: memoryview, at: int) -> tuple[bytes, int]:
    """The plain bytes of the gzip member at ``at``, and where it ends."""
    tool, out = zlib.decompressobj(31), []
    while not tool.eof:
        part = data[at : at + 16384]
        if not len(part):
            raise ValueError("a member is cut off")
        out.append(tool.decompress(part))
        at += len(part) - len(tool.unused_data)
    return b"".join(out), at


def read_record(data: memoryview, at: int) -> tuple[dict[bytes, str], bytes, int]:
    """Header fields and block of the record whose first member is at ``at``, and where it ends."""
    plain, end = _inflated(data, at)
    while (top := plain.find(b"\r\n\r\n") + 4) < 4:
        more, end = _inflated(data, end)
        plain += more
    head = {k.strip().lower(): v.strip().decode("utf-8") for k, v in HEADER.findall(plain[plain.index(b"\r\n") + 2 : top - 2])}
    size = int(head[b"content-length"])
    parts, have = [plain], len(plain)
    while have < top + size + 4 and end < len(data):
        more, end = _inflated(data, end)
        parts.append(more)
        have += len(more)
    plain = b"".join(parts)
    if len(plain) != top + size + 4 or plain[-4:] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut off")
    return head, plain[top : top + size], end


def parse_archive(name: str, data: bytes) -> Iterator[tuple]:
    """Index entries of an archive in file order, without their place in the run; one record is inflated at a time."""
    at, view = 0, memoryview(data)
    while at < len(data):
        head, block, end = read_record(view, at)
        cut = block.index(b"\r\n\r\n") + 4
        page, refers = (ID.match(head.get(x, "")) for x in (b"warc-record-id", b"warc-refers-to"))
        if head[b"warc-type"] == "revisit":
            length = int(dict(HEADER.findall(block[:cut]))[b"Content-Length"])
            digest = head[b"warc-payload-digest"].partition(":")[2]
        else:
            length, digest = len(block) - cut, hashlib.sha1(memoryview(block)[cut:]).hexdigest()
            if f"sha1:{digest}" != head[b"warc-payload-digest"]:
                raise ValueError(f"{name}: the record at {at} does not match its digest")
        url = head.get(b"warc-target-uri")
        yield url_key(url), head[b"warc-date"], int(page[1]) if page else None, url, head[b"warc-type"], int(refers[1]) if refers else None, length, digest, name, at, end - at
        at = end


def _order(entry: tuple) -> tuple:
    """URL key, timestamp, page (null first), archive and offset: no two entries are alike."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[8], entry[9]


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 5000) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


ARROW_INDEX = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[t]) for n, t in (x.split() for x in INDEX.split(", "))])


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The index entries of each archive, sorted, with their place in that run."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                entries = sorted(parse_archive(name, content.as_py()), key=_order)
                yield from _batches(((*e, i) for i, e in enumerate(entries)), ARROW_INDEX)

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(read, INDEX)


class LoserTree:
    """k-way merge of iterators of (key, item): inner nodes keep the loser of their match, so a pop replays one path."""

    def __init__(self, sources: list[Iterator[tuple]]) -> None:
        self.sources = sources
        self.k = len(sources)
        self.heads = [next(x, None) for x in sources]
        self.losers = [-1] * max(1, self.k)
        self.winner = self._play() if self.k else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def _play(self) -> int:
        """Play all matches, from the leaves (nodes k to 2 k - 1) up; the winner."""
        won = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = won[2 * node], won[2 * node + 1]
            won[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return won[1]

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.winner] is not None:
            best = self.winner
            yield self.heads[best][1]
            self.heads[best] = next(self.sources[best], None)
            node = (best + self.k) // 2
            while node:
                if self._beats(self.losers[node], best):
                    self.losers[node], best = best, self.losers[node]
                node //= 2
            self.winner = best


def merge_index(entries: DataFrame, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """All entries numbered from 0 in one order, by ``capture_order``.

    A range's slices come in the order of their runs (sorted outside Python, on disk where they are
    large) and stay one Arrow table; the tree moves row numbers.
    """
    names = ARROW_INDEX.names

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), ARROW_INDEX).combine_chunks()
        if not table.num_rows:
            return
        keys = [table.column(c) for c in ("url_key", "timestamp", "page_id", "archive", "offset")]

        def source(start: int, stop: int) -> Iterator[tuple]:
            for at in range(start, stop):
                url, moment, page, archive, offset = (c[at].as_py() for c in keys)
                yield (url, moment, page is not None, page or 0, archive, offset), at

        runs_ = table.column("archive").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = [0, *(int(x) + 1 for x in (runs_[1:] != runs_[:-1]).nonzero()[0]), table.num_rows]
        order = list(LoserTree([source(a, b) for a, b in zip(starts, starts[1:], strict=False)]))
        for at in range(0, len(order), 5000):
            yield from table.take(pa.array(order[at : at + 5000])).combine_chunks().to_batches()

    ranges = max(1, -(-entries.count() // range_entries))
    dealt = entries.select(*names).repartitionByRange(ranges, "url_key", "timestamp", "page_id", "archive", "offset").sortWithinPartitions("archive", "run_place")
    merged = materialize(dealt.mapInArrow(merge, INDEX).drop("run_place").withColumn("_at", F.monotonically_increasing_id()))
    counts = merged.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = merged.withColumn("_range", F.shiftright("_at", 33)).join(starts, "_range")
    return placed.withColumn("capture_order", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_range", "_start")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """The merged index of the archives below ``path``."""
    return merge_index(materialize(runs(spark, path)))
