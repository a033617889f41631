"""Media columns of progressive JPEG.

The decoder reads SOF2 streams: scans are entropy-decoded into coefficient arrays, spectral band by
band and bit by bit, the arrays go through an integer inverse transform in numpy, chroma is
upsampled by repetition and the result is a full-resolution RGB tensor. All restart intervals of all
images of a batch that use the same scan are decoded in step, one symbol of each at a time, so the
number of numpy calls depends on the longest interval and not on the number of images.

A payload is kept in the format's own unit, the coefficient: 64 bytes fill one 8x8 block, one byte a
coefficient, which no transform rounds. AC bytes become the 256 coefficients of size category 8.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: the zigzag order of an 8x8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda n: (n // 8 + n % 8, (n // 8 if (n // 8 + n % 8) % 2 else n % 8))))
#: Horizontal and vertical sampling factors of each component that the writer uses.
SAMPLING = ((2, 2), (1, 1), (1, 1))
#: (components, first and last coefficient, high and low bit) of each scan that the writer makes.
SCANS = (((0, 1, 2), 0, 0, 0, 1), *(((c,), 1, 5, 0, 1) for c in range(3)), *(((c,), 6, 63, 0, 1) for c in range(3)), *(((c,), 1, 63, 1, 0) for c in range(3)), ((0, 1, 2), 0, 0, 1, 0))
RESTART_BLOCKS = 4
RESTART_UNITS = 4
BATCH_BYTES = 1 << 20
SCALE = 12


def _bases() -> np.ndarray:
    """Row k: the 64 samples of zigzag coefficient k, scaled by 2 ** SCALE and rounded."""
    n = np.arange(8)
    one = np.cos((2 * n[None, :] + 1) * n[:, None] * np.pi / 16) * np.where(n == 0, 0.5**0.5, 1.0)[:, None] / 2
    return np.rint(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64) * (1 << SCALE))[ZIGZAG]


BASES = _bases()


@dataclass(frozen=True)
class Huffman:
    """A table given by the number of codes of each length and the symbols in order of their codes."""

    counts: bytes
    symbols: bytes

    @classmethod
    def favouring(cls, symbol: int) -> Huffman:
        """All 256 symbols: ``symbol`` in one bit, the others in nine."""
        rest = bytes(x for x in range(256) if x != symbol)
        return cls(bytes([1, 0, 0, 0, 0, 0, 0, 0, 255, *[0] * 7]), bytes([symbol]) + rest)

    @classmethod
    def flat(cls, n: int, bits: int) -> Huffman:
        return cls(bytes(n if i + 1 == bits else 0 for i in range(16)), bytes(range(n)))

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and length of each symbol (length 0: none)."""
        code, at = 0, 0
        codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for bits in range(1, 17):
            for symbol in self.symbols[at : at + self.counts[bits - 1]]:
                codes[symbol], lengths[symbol] = code, bits
                code += 1
            at += self.counts[bits - 1]
            code <<= 1
        return codes, lengths

    def lookup(self) -> np.ndarray:
        """length << 8 | symbol for each 16 bits that may come next."""
        table = np.zeros(1 << 16, np.int64)
        codes, lengths = self.codes()
        for symbol in self.symbols:
            low = codes[symbol] << (16 - lengths[symbol])
            table[low : low + (1 << (16 - lengths[symbol]))] = lengths[symbol] << 8 | symbol
        return table


DC_TABLE, AC_TABLE, REFINE_TABLE = Huffman.flat(12, 4), Huffman.favouring(0x07), Huffman.favouring(0x20)
_SIZE = np.zeros(1 << 12, np.int64)
for _bits in range(12):
    _SIZE[1 << _bits : 2 << _bits] = _bits + 1


@dataclass
class Image:
    """Coefficients in zigzag order, one row a block, components after each other in raster order."""

    mcus_x: int
    mcus_y: int
    coefficients: np.ndarray
    comment: bytes = b""
    quant: np.ndarray = field(default_factory=lambda: np.ones((3, 64), np.int64))
    sampling: tuple[tuple[int, int], ...] = SAMPLING
    size: tuple[int, int] | None = None

    def grid(self, c: int) -> tuple[int, int]:
        """Rows and columns of blocks of a component, whole units."""
        h, v = self.sampling[c]
        return self.mcus_y * v, self.mcus_x * h

    def blocks(self, c: int) -> int:
        rows, columns = self.grid(c)
        return rows * columns

    def first(self, c: int) -> int:
        return sum(self.blocks(i) for i in range(c))

    def covered(self, c: int) -> tuple[int, int]:
        """Rows and columns of blocks that hold pixels: all that a scan of this component alone brings."""
        if self.size is None:
            return self.grid(c)
        (h, v), (most_h, most_v) = self.sampling[c], (max(x) for x in zip(*self.sampling))
        return -(-(-(-self.size[1] * v // most_v)) // 8), -(-(-(-self.size[0] * h // most_h)) // 8)

    def order(self, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Block rows in scan order, and the component of each place of a unit."""
        return _scan_order(self.mcus_x, self.mcus_y, self.sampling, components, self.covered(components[0]) if len(components) == 1 else (0, 0))


@lru_cache(maxsize=8192)
def _scan_order(mcus_x: int, mcus_y: int, sampling: tuple[tuple[int, int], ...], components: tuple[int, ...], covered: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    firsts = np.cumsum([0, *(mcus_x * mcus_y * h * v for h, v in sampling)])
    if len(components) == 1:
        c = components[0]
        h, v = sampling[c]
        grid = np.arange(mcus_y * v * mcus_x * h).reshape(mcus_y * v, mcus_x * h) + firsts[c]
        return grid[: covered[0], : covered[1]].reshape(-1, 1), np.array([c])
    parts, slots = [], []
    for c in components:
        h, v = sampling[c]
        grid = np.arange(mcus_y * v * mcus_x * h).reshape(mcus_y, v, mcus_x, h).transpose(0, 2, 1, 3)
        parts.append(grid.reshape(-1, h * v) + firsts[c])
        slots += [c] * (h * v)
    return np.concatenate(parts, axis=1), np.array(slots)


# ---- writer ---------------------------------------------------------------------------------


def _magnitude_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v >= 0, v, v + (np.int64(1) << size) - 1)


class _Bits:
    """Codes of many lanes; every lane starts at a byte and ends in one-bits."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, lane: np.ndarray, key: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        self.parts.append(tuple(np.broadcast_to(np.asarray(x, np.int64), np.shape(lane)) for x in (lane, key, value, bits)))

    def pack(self, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all lanes, and where each lane ends."""
        lane, key, value, bits = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 4
        if len(self.parts) > 1:
            order = np.lexsort((key, lane))
            lane, value, bits = lane[order], value[order], bits[order]
        used = np.bincount(lane, bits, lanes).astype(np.int64)
        sizes = (used + 7) // 8
        ends = np.cumsum(sizes)
        shift = 8 * (ends - sizes) - (np.cumsum(used) - used)
        at = np.cumsum(bits) - bits + shift[lane]
        pad = 8 * sizes - used
        words = np.zeros(int(ends[-1]) // 4 + 3 if lanes else 3, np.uint64)
        for start, code, n in ((at, value, bits), (8 * ends - pad, (np.int64(1) << pad) - 1, pad)):
            if not len(start):
                continue
            word = start >> 5
            moved = code.astype(np.uint64) << (64 - (start & 31) - n).astype(np.uint64)
            moved[n == 0] = 0
            firsts = np.flatnonzero(np.diff(word, prepend=-1))
            high = np.add.reduceat(moved >> np.uint64(32), firsts)
            low = np.add.reduceat(moved & np.uint64(0xFFFFFFFF), firsts)
            words[word[firsts]] += high
            words[word[firsts] + 1] += low
        return words.astype(">u4").view(np.uint8)[: int(ends[-1]) if lanes else 0], ends


def _first_ac(bits: _Bits, c: np.ndarray, lane: np.ndarray, low: int, high_k: int, first_k: int) -> None:
    codes, lengths = AC_TABLE.codes()
    band = c[:, first_k : high_k + 1]
    v = np.sign(band) * (np.abs(band) >> low)
    width = high_k - first_k + 1
    full = (v != 0).all(axis=1)
    if full.any():
        dense = v[full]
        sizes = _SIZE[np.abs(dense)]
        keys = np.flatnonzero(full)[:, None] * (4 * (width + 1)) + 4 * np.arange(width) + 3
        coded = codes[sizes] << sizes | _magnitude_bits(dense, sizes)
        bits.add(np.repeat(lane[full], width), keys.ravel(), coded.ravel(), (lengths[sizes] + sizes).ravel())
    rest = np.flatnonzero(~full)
    row, col = np.nonzero(v[rest])
    row = rest[row]
    value = v[row, col]
    before = np.full(len(col), -1)
    if len(col):
        same = row[1:] == row[:-1]
        before[1:][same] = col[:-1][same]
    run = col - before - 1
    size = _SIZE[np.abs(value)]
    symbol = (run & 15) << 4 | size
    bits.add(lane[row], row * 4 * (width + 1) + 4 * col + 3, codes[symbol] << size | _magnitude_bits(value, size), lengths[symbol] + size)
    for n in range(3):
        at = run >> 4 > n
        if at.any():
            bits.add(lane[row[at]], row[at] * 4 * (width + 1) + 4 * col[at] + n, codes[0xF0], lengths[0xF0])
    last = np.where(full, width - 1, -1)
    last[row] = col
    ends = np.flatnonzero(last < width - 1)
    if len(ends):
        bits.add(lane[ends], ends * 4 * (width + 1) + 4 * width, codes[0], lengths[0])


def _refine_ac(bits: _Bits, c: np.ndarray, lane: np.ndarray, low: int, high_k: int, first_k: int) -> None:
    codes, lengths = REFINE_TABLE.codes()
    band = np.abs(c[:, first_k : high_k + 1])
    known = band >> (low + 1) != 0
    now = band >> low != 0
    width = high_k - first_k + 1
    step = 4 * width + 8
    plain = ~np.isin(lane, lane[(now & ~known).any(axis=1)])
    rows = np.flatnonzero(plain)
    if len(rows):
        lanes, firsts, count = np.unique(lane[rows], return_index=True, return_counts=True)
        n = _SIZE[count] - 1
        bits.add(lanes, rows[firsts] * step, codes[n << 4] << n | (count - (np.int64(1) << n)), lengths[n << 4] + n)
        bit = band[rows] >> low & 1
        full = known[rows].all(axis=1)
        for at in range(0, width, 24):
            part = bit[full, at : at + 24]
            bits.add(lane[rows[full]], rows[full] * step + 1 + at, part @ (np.int64(1) << np.arange(part.shape[1])[::-1]), np.full(len(part), part.shape[1]))
        r, k = np.nonzero(known[rows] & ~full[:, None])
        if len(r):
            bits.add(lane[rows[r]], rows[r] * step + 1 + k, bit[r, k], np.ones(len(r)))
    for row in np.flatnonzero(~plain):
        _refine_block(bits, c[row, first_k : high_k + 1], known[row], now[row], int(lane[row]), row * step, low, codes, lengths)


def _refine_block(bits: _Bits, band: np.ndarray, known: np.ndarray, now: np.ndarray, lane: int, key: int, low: int, codes: np.ndarray, lengths: np.ndarray) -> None:
    """One block with coefficients that become non-zero in this scan."""
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    run = 0
    left = int((now & ~known).sum())
    for k in range(len(band)):
        if known[k]:
            held.append((int(abs(band[k])) >> low & 1, 1))
        elif not now[k]:
            run += 1
            if run == 16 and left:
                out += [(int(codes[0xF0]), int(lengths[0xF0])), *held]
                held, run = [], 0
        else:
            symbol = run << 4 | 1
            out += [(int(codes[symbol]) << 1 | int(band[k] > 0), int(lengths[symbol]) + 1), *held]
            held, run, left = [], 0, left - 1
    if run or held:
        out += [(int(codes[0]), int(lengths[0])), *held]
    if out:
        value, size = np.array(out).T
        bits.add(np.full(len(out), lane), key + np.arange(len(out)), value, size)


def _dc(bits: _Bits, c: np.ndarray, units: np.ndarray, slots: np.ndarray, lane: np.ndarray, high: int, low: int) -> None:
    dc = c[units, 0]
    key = np.arange(units.size).reshape(units.shape)
    lanes = np.broadcast_to(lane[:, None], units.shape)
    if high:
        bits.add(lanes.ravel(), key.ravel(), (dc >> low & 1).ravel(), np.ones(units.size))
        return
    codes, lengths = DC_TABLE.codes()
    v = dc >> low
    diff = v.copy()
    for component in np.unique(slots):
        part = v[:, slots == component]
        before = np.concatenate([np.concatenate([[0], part[:-1, -1]])[:, None], part[:, :-1]], axis=1)
        before[np.flatnonzero(np.diff(lane, prepend=-1)), 0] = 0
        diff[:, slots == component] = part - before
    size = _SIZE[np.abs(diff)]
    bits.add(lanes.ravel(), key.ravel(), (codes[size] << size | _magnitude_bits(diff, size)).ravel(), (lengths[size] + size).ravel())


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _stuffed(data: np.ndarray, ends: np.ndarray, closing: np.ndarray, place: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Zero bytes after 0xFF, restart markers after each lane but the closing ones; new lane ends."""
    full = data == 255
    stuffed = np.concatenate([[0], np.cumsum(full)])
    marked = np.cumsum(~closing) - ~closing
    sizes = np.diff(ends, prepend=0)
    lane_shift = np.repeat(2 * marked, sizes)
    at = np.arange(len(data)) + stuffed[:-1] + lane_shift
    new_ends = ends + stuffed[ends] + 2 * marked
    out = np.zeros(int(new_ends[-1]) + 2 if len(ends) else 0, np.uint8)
    out[at] = data
    stops = new_ends[~closing]
    out[stops] = 255
    out[stops + 1] = 0xD0 + place[~closing] % 8
    return out.tobytes(), new_ends


def write_images(images: list[Image]) -> list[bytes]:
    """Progressive streams of images of equal quantisation by ``SCANS``, with restart intervals."""
    if not images:
        return []
    c = np.concatenate([x.coefficients for x in images]).astype(np.int64)
    base = np.cumsum([0, *(len(x.coefficients) for x in images)])[:-1]
    out = []
    tables = b"".join(_segment(0xC4, bytes([kind]) + t.counts + t.symbols) for kind, t in ((0x00, DC_TABLE), (0x10, AC_TABLE), (0x11, REFINE_TABLE)))
    for x in images:
        w, h = x.size or (16 * x.mcus_x, 16 * x.mcus_y)
        head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + (_segment(0xFE, x.comment) if x.comment else b"")
        quants = [q.astype(np.uint8).tobytes() for q in x.quant]
        head += b"".join(_segment(0xDB, bytes([quants.index(q)]) + q) for q in dict.fromkeys(quants))
        head += _segment(0xC2, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([3]) + b"".join(bytes([i + 1, s << 4 | v, quants.index(quants[i])]) for i, (s, v) in enumerate(x.sampling)))
        head += tables
        out.append([head])
    for components, first_k, last_k, high, low in SCANS:
        interval = RESTART_BLOCKS if len(components) == 1 else RESTART_UNITS
        orders = [x.order(components) for x in images]
        units = np.concatenate([u + b for (u, _), b in zip(orders, base, strict=True)])
        counts = np.array([len(u) for u, _ in orders])
        lanes_of = -(-counts // interval)
        starts = np.cumsum(counts) - counts
        within = np.arange(len(units)) - np.repeat(starts, counts)
        lane = np.repeat(np.cumsum(lanes_of) - lanes_of, counts) + within // interval
        bits = _Bits()
        if first_k == 0:
            _dc(bits, c, units, orders[0][1], lane, high, low)
        else:
            (_refine_ac if high else _first_ac)(bits, c[units[:, 0]], lane, low, last_k, first_k)
        lanes = int(lanes_of.sum())
        data, ends = bits.pack(lanes)
        closing = np.zeros(lanes, bool)
        closing[np.cumsum(lanes_of) - 1] = True
        place = np.arange(lanes) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
        stream, ends = _stuffed(data, ends, closing, place)
        table = 0x00 if first_k == 0 else (0x01 if high else 0x00)
        head = _segment(0xDD, interval.to_bytes(2, "big")) + _segment(0xDA, bytes([len(components)]) + b"".join(bytes([i + 1, table]) for i in components) + bytes([first_k, last_k, high << 4 | low]))
        at = 0
        for parts, end in zip(out, ends[closing].tolist(), strict=True):
            parts += [head, stream[at:end]]
            at = end
    return [b"".join([*x, b"\xff\xd9"]) for x in out]


# ---- reader ---------------------------------------------------------------------------------


@dataclass
class Scan:
    image: int
    components: tuple[int, ...]
    tables: tuple[Huffman | None, ...]
    band: tuple[int, int, int, int]
    interval: int
    lanes: tuple[int, int, int]
    depth: int


@lru_cache(maxsize=1024)
def _tables(body: bytes) -> dict[int, Huffman]:
    """The tables of a DHT segment by class and number."""
    out = {}
    while body:
        count = sum(body[1:17])
        out[body[0]] = Huffman(body[1:17], body[17 : 17 + count])
        body = body[17 + count :]
    return out


@lru_cache(maxsize=1024)
def _scan_header(body: bytes, ids: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, int, int, int]]:
    """Components, table of each, and (first, last coefficient, high, low bit) of an SOS segment."""
    count = body[0]
    first_k, last_k, bit = body[1 + 2 * count :]
    which = tuple(ids.index(body[1 + 2 * j]) for j in range(count))
    return which, tuple(body[2 + 2 * j] >> 4 if first_k == 0 else 0x10 | body[2 + 2 * j] & 15 for j in range(count)), (first_k, last_k, bit >> 4, bit & 15)


def _parse(data: bytes, at: int, end: int, marks: list[int], closing: list[int], index: int, n: int) -> tuple[Image, list[Scan]]:
    """Headers and scans of the image in data[at:end].

    ``marks``: places of all markers; ``closing``: for each the next one that is no restart. The
    lanes of a scan are its first byte and the range of ``marks`` that are its restarts.
    """
    image, scans, quant, tables, interval, comment = None, [], {}, {}, 0, b""
    ids: list[tuple[int, int, int]] = []
    depths: dict[int, int] = {}
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    at += 2
    while at < end:
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            tables.update(_tables(body))
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xC2:
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            ids = [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(body[5])]
            sampling = tuple((x[1] >> 4, x[1] & 15) for x in ids) if len(ids) > 1 else ((1, 1),)
            most_h, most_v = (max(x) for x in zip(*sampling, strict=True))
            if len(ids) not in (1, 3) or any(not a or not b or most_h % a or most_v % b for a, b in sampling):
                raise ValueError("unsupported components or sampling")
            if not w * h or body[0] != 8:
                raise ValueError("unsupported size or precision")
            image = Image(-(-w // (8 * most_h)), -(-h // (8 * most_v)), np.zeros((0, 64), np.int32), sampling=sampling, size=(w, h))
            # Each block takes at least a bit of its first scan, so a short stream cannot ask for much memory.
            if sum(map(image.blocks, range(len(sampling)))) > 8 * (end - at):
                raise ValueError("more blocks than bits")
        elif marker in (0xC0, 0xC1):
            raise ValueError("not a progressive stream")
        elif marker == 0xDA:
            which, chosen, band = _scan_header(body, tuple(x[0] for x in ids))
            uses = tuple(map(tables.get, chosen))
            n = bisect_left(marks, at, n)
            last = closing[n]
            lanes, at = (at, n, last), marks[last]
            n = last
            depth = 1 + max(depths.get(i, 0) for i in which)
            depths.update(dict.fromkeys(which, depth))
            scans.append(Scan(index, which, uses, band, interval, lanes, depth))
    if image is None or not scans:
        raise ValueError("no frame or no scan")
    image.comment = comment
    image.quant = np.stack([quant[x[2]] for x in ids])
    return image, scans


class _Stream:
    """All entropy-coded bytes of a batch without stuffing: 40-bit windows and single bits."""

    def __init__(self, data: np.ndarray) -> None:
        keep = np.ones(len(data), bool)
        keep[1:] = ~((data[:-1] == 255) & (data[1:] == 0))
        self.moved = np.concatenate([[0], np.cumsum(keep)])
        self.bytes = np.concatenate([data[keep], np.full(8, 255, np.uint8)])
        b = self.bytes.astype(np.int64)
        self.windows = b[:-4] << 32 | b[1:-3] << 24 | b[2:-2] << 16 | b[3:-1] << 8 | b[4:]
        self.bits = np.unpackbits(self.bytes)

    def peek(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.windows[at >> 3] >> (40 - n - (at & 7)) & ((1 << n) - 1)

    def take(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``n`` (at most 16) bits of each."""
        return self.windows[at >> 3] >> (40 - n - (at & 7)) & ((np.int64(1) << n) - 1)


def _extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (np.int64(1) << size >> 1), bits - (np.int64(1) << size) + 1, bits)


def _read_dc(s: _Stream, c: np.ndarray, at: np.ndarray, units: np.ndarray, lengths: np.ndarray, slots: np.ndarray, lookups: dict[int, np.ndarray], high: int, low: int) -> None:
    """``units``: block rows by lane and place; ``lengths``: places of each lane."""
    before = np.zeros((len(at), int(slots.max()) + 1), np.int64)
    for place in range(units.shape[1]):
        live = np.flatnonzero(place < lengths)
        where, p = units[live, place], at[live]
        if high:
            c[where, 0] |= s.bits[p].astype(np.int32) << low
            at[live] += 1
            continue
        slot = int(slots[place % len(slots)])
        found = lookups[slot][s.peek(p, 16)]
        size = found & 255
        p += found >> 8
        before[live, slot] += _extended(s.take(p, size), size)
        at[live] = p + size
        c[where, 0] = before[live, slot] << low


def _read_ac(s: _Stream, c: np.ndarray, at: np.ndarray, units: np.ndarray, lengths: np.ndarray, lookup: np.ndarray, first_k: int, last_k: int, low: int) -> None:
    block = np.zeros(len(at), np.int64)
    k = np.full(len(at), first_k, np.int64)
    live = np.flatnonzero(lengths > 0)
    flat = c.reshape(-1)
    while len(live):
        p, kk, b = at[live], k[live], block[live]
        shift = p & 7
        window = s.windows[p >> 3]
        found = lookup[window >> (24 - shift) & 0xFFFF]
        size = found & 15
        run = found >> 4 & 15
        length = found >> 8
        value = size > 0
        bits = window >> (40 - shift - length - size) & ((np.int64(1) << size) - 1)
        deep = length + size + shift > 40
        if deep.any():
            bits[deep] = s.take(p[deep] + length[deep], size[deep])
        kk += run
        v = _extended(bits, size) << low
        if value.all():
            flat[units[live, b] * 64 + kk] = v
            p += length + size
            kk += 1
        else:
            flat[units[live[value], b[value]] * 64 + kk[value]] = v[value]
            ends = ~value & (run < 15)
            p += length + size
            kk += 1
            if ends.any():
                more = s.take(p[ends], run[ends]) + (np.int64(1) << run[ends])
                p[ends] += run[ends]
                kk[ends] = last_k + 1
                b[ends] += more - 1
        at[live] = p
        done = kk > last_k
        b += done
        kk[done] = first_k
        block[live], k[live] = b, kk
        if done.any():
            live = live[b < lengths[live]]


def _refine_one(s: _Stream, row: np.ndarray, at: int, lookup: np.ndarray, first_k: int, last_k: int, low: int) -> tuple[int, int]:
    """One block outside a run of ended bands; the new place, and blocks of the run that it starts."""
    one = np.array([0])
    k = first_k
    while k <= last_k:
        one[0] = at
        found = int(lookup[s.peek(one, 16)[0]])
        at += found >> 8
        run, size = found >> 4 & 15, found & 15
        if not size and run < 15:
            one[0] = at
            blocks = (1 << run) + int(s.take(one, np.array([run]))[0])
            return at + run, -(blocks * 128 + k)
        new = 0
        if size:
            new = (1 if s.bits[at] else -1) << low
            at += 1
        while k <= last_k:
            if row[k]:
                if s.bits[at]:
                    row[k] += int(np.sign(row[k])) << low
                at += 1
            elif run == 0:
                row[k] = new
                k += 1
                break
            else:
                run -= 1
            k += 1
    return at, 0


def _refine_rest(s: _Stream, c: np.ndarray, rows: np.ndarray, at: np.ndarray, start: int, last_k: int, low: int) -> np.ndarray:
    """Correction bits of all non-zero coefficients from ``start``; the new places."""
    band = c[rows, start : last_k + 1]
    known = band != 0
    rank = np.cumsum(known, axis=1)
    bit = s.bits[np.minimum(at[:, None] + rank - 1, len(s.bits) - 1)].astype(np.int32)
    c[rows, start : last_k + 1] = band + np.where(known, np.sign(band) * bit << low, 0)
    return at + rank[:, -1]


def _read_refinement(s: _Stream, c: np.ndarray, at: np.ndarray, units: np.ndarray, lengths: np.ndarray, lookup: np.ndarray, first_k: int, last_k: int, low: int) -> None:
    ended = np.zeros(len(at), np.int64)
    for block in range(units.shape[1]):
        live = np.flatnonzero(block < lengths)
        fresh = live[ended[live] == 0]
        if len(fresh):
            found = lookup[s.peek(at[fresh], 16)]
            run = found >> 4 & 15
            plain = (found & 15 == 0) & (run < 15)
            p = at[fresh] + (found >> 8)
            at[fresh[plain]] = p[plain] + run[plain]
            ended[fresh[plain]] = s.take(p[plain], run[plain]) + (np.int64(1) << run[plain])
            for i in fresh[~plain]:
                place, state = _refine_one(s, c[units[i, block]], int(at[i]), lookup, first_k, last_k, low)
                at[i] = place
                if state:
                    blocks, k = divmod(-state, 128)
                    if k <= last_k:
                        at[i : i + 1] = _refine_rest(s, c, units[i : i + 1, block], at[i : i + 1], k, last_k, low)
                    ended[i] = blocks - 1
            live = np.setdiff1d(live, fresh[~plain], assume_unique=True) if not plain.all() else live
        if len(live):
            at[live] = _refine_rest(s, c, units[live, block], at[live], first_k, last_k, low)
            ended[live] -= 1


def read_images(streams: list[bytes]) -> list[Image]:
    """Coefficients of each stream (one of them may hold any progressive script and tables)."""
    data = b"".join(streams)
    raw = np.frombuffer(data, np.uint8)
    places = np.flatnonzero((raw[:-1] == 255) & (raw[1:] != 0))
    ends = np.where(raw[places + 1] & 0xF8 == 0xD0, len(places), np.arange(len(places)))
    closing = np.minimum.accumulate(ends[::-1])[::-1].tolist()
    marks = places.tolist()
    images, scans, at = [], [], 0
    n = 0
    for i, stream in enumerate(streams):
        n = bisect_left(marks, at, n)
        image, found = _parse(data, at, at + len(stream), marks, closing, i, n)
        images.append(image)
        scans += found
        at += len(stream)
    sizes = [sum(x.blocks(i) for i in range(len(x.sampling))) for x in images]
    base = np.cumsum([0, *sizes])
    c = np.zeros((int(base[-1]), 64), np.int32)
    stream = _Stream(raw)
    groups: dict[tuple, list[Scan]] = {}
    for x in scans:
        tables = dict(zip(x.components, x.tables, strict=True)) if x.band[0] == 0 else x.tables[0]
        # Units of other samplings hold other places, so scans of several components go together only where their units agree.
        slots = tuple(images[x.image].order(x.components)[1].tolist()) if x.band[0] == 0 else None
        groups.setdefault((x.depth, x.band, slots, tuple(tables.items()) if isinstance(tables, dict) else tables), []).append(x)
    lookups: dict[Huffman, np.ndarray] = {}
    for (_, band, _, tables), group in sorted(groups.items(), key=lambda g: g[0][0]):
        first_k, last_k, high, low = band
        orders = [images[x.image].order(x.components) for x in group]
        slots = orders[0][1]
        counts = np.array([len(o) for o, _ in orders])
        per = np.array([x.interval or n for x, n in zip(group, counts, strict=True)])
        lanes = -(-counts // per)
        lengths = np.repeat(per, lanes)
        lengths[np.cumsum(lanes) - 1] = counts - (lanes - 1) * per
        lengths = lengths * len(slots)
        rows = np.concatenate([o.ravel() + base[x.image] for (o, _), x in zip(orders, group, strict=True)])
        units = np.zeros((len(lengths), int(lengths.max())), np.int64)
        units[np.arange(units.shape[1]) < lengths[:, None]] = rows
        starts = np.concatenate([part for x in group for part in ([x.lanes[0]], places[x.lanes[1] : x.lanes[2]] + 2)])
        if len(starts) != len(lengths):
            raise ValueError("restart intervals do not cover the scan")
        ends = stream.moved[np.concatenate([places[x.lanes[1] : x.lanes[2] + 1] for x in group])] * 8
        at = stream.moved[starts] * 8
        for t in tables and (dict(tables).values() if first_k == 0 else [tables]) or []:
            if t is not None and t not in lookups:
                lookups[t] = t.lookup()
        if first_k == 0:
            _read_dc(stream, c, at, units, lengths, slots, {k: lookups.get(t) for k, t in tables}, high, low)
        elif high:
            _read_refinement(stream, c, at, units, lengths, lookups[tables], first_k, last_k, low)
        else:
            _read_ac(stream, c, at, units, lengths, lookups[tables], first_k, last_k, low)
        if ((at > ends) | (at <= ends - 8)).any():
            raise ValueError("a scan does not end where its data do")
    for x, a, b in zip(images, base, base[1:], strict=False):
        x.coefficients = c[a:b]
    return images


def rgb_tensors(images: list[Image]) -> list[np.ndarray]:
    """Full-resolution (height, width, 3) bytes of each image. All arithmetic is on whole numbers."""
    if not images:
        return []
    scaled = np.concatenate([x.coefficients[x.first(i) : x.first(i) + x.blocks(i)] * x.quant[i] for x in images for i in range(len(x.sampling))]).astype(np.float64)
    samples = np.clip((((scaled @ BASES).astype(np.int64) + (1 << (SCALE - 1))) >> SCALE) + 128, 0, 255).astype(np.int32)
    out, at = [], 0
    for x in images:
        planes = []
        most_h, most_v = (max(n) for n in zip(*x.sampling, strict=True))
        for i, (sh, sv) in enumerate(x.sampling):
            h, w = x.grid(i)
            plane = samples[at : at + h * w].reshape(h, w, 8, 8).transpose(0, 2, 1, 3).reshape(8 * h, 8 * w)
            at += h * w
            down, along = most_v // sv, most_h // sh
            plane = plane.repeat(down, axis=0) if down > 1 else plane
            planes.append(plane.repeat(along, axis=1) if along > 1 else plane)
        rgb = np.empty((*planes[0].shape, 3), np.uint8)
        if len(planes) == 1:
            rgb[...] = planes[0][..., None]
        else:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            rgb[..., 0] = np.clip(y + (91881 * cr + 32768 >> 16), 0, 255)
            rgb[..., 1] = np.clip(y - (22554 * cb + 46802 * cr + 32768 >> 16), 0, 255)
            rgb[..., 2] = np.clip(y + (116130 * cb + 32768 >> 16), 0, 255)
        width, height = x.size or (rgb.shape[1], rgb.shape[0])
        out.append(rgb[:height, :width])
    return out


# ---- payloads -------------------------------------------------------------------------------


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the text padded with zero bytes to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def payload_image(payload: bytes) -> Image:
    values = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(np.int32)
    mcus = -(-len(values) // 6)
    mx = int(np.ceil(mcus**0.5))
    image = Image(mx, -(-mcus // mx), np.zeros((0, 64), np.int32), b"payload-blocks=%d" % len(values))
    image.coefficients = np.zeros((6 * image.mcus_x * image.mcus_y, 64), np.int32)
    image.coefficients[: len(values), 0] = values[:, 0] - 128
    image.coefficients[: len(values), 1:] = np.where(values[:, 1:] >= 128, values[:, 1:], values[:, 1:] - 255)
    return image


def payload_from(image: Image) -> bytes:
    n = int(image.comment.partition(b"payload-blocks=")[2])
    c = image.coefficients[:n]
    values = np.where(c < 0, c + 255, c)
    values[:, 0] = c[:, 0] + 128
    return values.astype(np.uint8).tobytes()


def feature(rgb: np.ndarray) -> str:
    """Width x height, the sum of each channel and the CRC of the tensor."""
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"{rgb.shape[1]}x{rgb.shape[0]}:" + ":".join(map(str, sums)) + f":{zlib.crc32(rgb.tobytes())}"


Decoded = tuple["Image | None", "np.ndarray | None", "str | None"]


def decoded(streams: list[bytes]) -> list[Decoded]:
    """Image, tensor and problem of each stream; streams that cannot be read are found by halving."""
    if not streams:
        return []
    try:
        images = read_images(streams)
        return [(x, t, None) for x, t in zip(images, rgb_tensors(images), strict=True)]
    except (ValueError, IndexError, KeyError, TypeError, OverflowError) as problem:
        if len(streams) == 1:
            return [(None, None, f"{type(problem).__name__}: {problem}")]
        half = len(streams) // 2
        return decoded(streams[:half]) + decoded(streams[half:])


def _chunks(sizes: list[int], most: int) -> Iterator[slice]:
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield slice(start, len(sizes))


def store_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): the payload of each text as a progressive JPEG.

    A null text is empty, repeated rows and null keys are stored as often as they come, long texts
    whole; other columns, whatever their names, are left out.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x.as_py() or "") if x.is_valid else 0 for x in batch.column(1)]
            for part in _chunks(sizes, BATCH_BYTES):
                made = [payload_of(x) for x in batch.column(1)[part].to_pylist()]
                media = write_images([payload_image(x) for _, x in made])
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    return df.select(key, text).mapInArrow(encode, f"{key} {df.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def read_media(df: DataFrame, media: str = "media", with_tensor: bool = False) -> DataFrame:
    """``df`` with payload, feature, problem and, if asked for, the RGB tensor of each stored image.

    Progressive streams of any size with one or three components are read. A null medium gives
    nulls; one that cannot be read gives nulls and the ``problem``, and harms no other row. Payloads
    are those that ``store_media`` wrote. Columns named payload, feature, problem, height, width or
    rgb are replaced; any other name is free.
    """
    own = ["payload", "feature", "problem"] + ["height", "width", "rgb"] * with_tensor
    kept = [c for c in df.columns if c not in own or c == media]
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(kept.index(media))
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in column]
            for part in _chunks(sizes, BATCH_BYTES):
                streams = column[part].to_pylist()
                found = iter(decoded([x for x in streams if x is not None]))
                rows = [next(found) if x is not None else (None, None, None) for x in streams]
                arrays = [c[part] for c in batch.columns]
                arrays.append(pa.array([payload_from(x) if x is not None and x.comment.startswith(b"payload-blocks=") else None for x, _, _ in rows], pa.binary()))
                arrays.append(pa.array([feature(t) if t is not None else None for _, t, _ in rows], pa.string()))
                arrays.append(pa.array([p for _, _, p in rows], pa.string()))
                if with_tensor:
                    for i in (0, 1):
                        arrays.append(pa.array([t.shape[i] if t is not None else None for _, t, _ in rows], pa.int32()))
                    arrays.append(pa.array([t.tobytes() if t is not None else None for _, t, _ in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *own])

    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", payload binary, feature string, problem string" + ", height int, width int, rgb binary" * with_tensor
    return df.select(*[f"`{c}`" for c in kept]).mapInArrow(decode, schema)


def digests(df: DataFrame) -> DataFrame:
    """What the stored and read-back media amount to."""
    read = read_media(df)
    return read.withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"),
        "payload_sha256": F.sha2("payload", 256),
        "tail_crc32": F.crc32(F.substring("payload", -64, 64)).cast("long"),
        "media_bytes": F.octet_length("media").cast("long"),
        "media_sha256": F.sha2("media", 256),
    }).drop("payload", "media", "problem")
