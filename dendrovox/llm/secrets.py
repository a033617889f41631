"""Secret scans: three fixed patterns and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:int,end:int>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy_hex", "entropy_base64")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
DIGIT, LETTER, LOWER, UPPER = (re.compile(x) for x in ("[0-9]", "[A-Za-z]", "[a-z]", "[A-Z]"))


@dataclass(frozen=True)
class CharClass:
    """Runs of ``members`` are slid over; windows of ``window`` with ``bits`` or more are secrets."""

    kind: str
    members: str
    window: int
    bits: float
    needs: tuple[re.Pattern, ...]

    @property
    def runs(self) -> re.Pattern:
        return re.compile(f"[{self.members}]{{{self.window},}}")


CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", 20, 3.0, (DIGIT, LETTER)),
    CharClass("entropy_base64", "A-Za-z0-9+/=_-", 20, 3.8, (DIGIT, LOWER, UPPER)),
)
ALLOWED = (
    re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"),
    re.compile(r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
    re.compile(r"example|placeholder|changeme|x{8}|0123456789|abcdefghij", re.IGNORECASE),
)


def entropy_windows(run: str, window: int) -> Iterator[float]:
    """Shannon entropy in bits of each window of ``run``; counts move by one character a step."""
    weigh = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, whole = 0.0, math.log2(window)
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += weigh[n + 1] - weigh[n]
        counts[c] = n + 1
        if i >= window:
            n = counts[run[i - window]]
            total += weigh[n - 1] - weigh[n]
            counts[run[i - window]] = n - 1
        if i >= window - 1:
            yield whole - total / window


def uncovered(found: list[tuple[int, int, str]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of ``found`` that lie in none of ``taken``: both in order of their starts, in one sweep."""
    out, bases, at, reach = [], sorted(taken), 0, -1
    for x in sorted(found):
        while at < len(bases) and bases[at][0] <= x[0]:
            reach = max(reach, bases[at][1])
            at += 1
        if reach < x[1]:
            out.append(x)
    return out


@dataclass(frozen=True)
class Scanner:
    classes: tuple[CharClass, ...] = CLASSES
    allowed: tuple[re.Pattern, ...] = ALLOWED
    runs: tuple[re.Pattern, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        object.__setattr__(self, "runs", tuple(x.runs for x in self.classes))

    def base(self, text: str) -> list[tuple[int, int, str]]:
        found = []
        if ":" in text or "=" in text:
            low = text.lower()
            if any(x in low for x in ("passw", "secret", "token", "api")):
                found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]

    def pieces(self, word: str) -> list[tuple[int, str]]:
        """What lies between the allowed strings of ``word``, with its places: the windows that touch none of them."""
        out, at = [], 0
        for start, end in sorted(m.span() for x in self.allowed for m in x.finditer(word)):
            if start > at:
                out.append((at, word[at:start]))
            at = max(at, end)
        return [*out, (at, word[at:])]

    def entropic(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Unions of qualifying windows, but for windows that touch an allowed string and unions inside a taken span."""
        found: list[tuple[int, int, str]] = []
        for candidate in CANDIDATE.finditer(text):
            if not DIGIT.search(candidate[0]):
                continue
            for at, piece in self.pieces(candidate[0]):
                for kind, runs in zip(self.classes, self.runs, strict=True):
                    for m in runs.finditer(piece):
                        base = candidate.start() + at + m.start()
                        start = end = -1
                        for i, bits in enumerate(entropy_windows(m[0], kind.window)):
                            if bits >= kind.bits and all(x.search(m[0], i, i + kind.window) for x in kind.needs):
                                if start >= 0 and i <= end:
                                    end = i + kind.window
                                    continue
                                if start >= 0:
                                    found.append((base + start, base + end, kind.kind))
                                start, end = i, i + kind.window
                        if start >= 0:
                            found.append((base + start, base + end, kind.kind))
        return uncovered(found, taken)

    def __call__(self, text: str | None) -> list[dict]:
        if not text:
            return []
        base = self.base(text)
        spans = sorted(base + self.entropic(text, base), key=lambda x: (x[0], KINDS.index(x[2]) if x[2] in KINDS else len(KINDS), x[1]))
        return [{"kind": k, "start": a, "end": b} for a, b, k in spans]


def secret_spans(text: Column, scanner: Scanner | None = None) -> Column:
    """Spans (kind, start, end) in code points, by start, then kind; a null text has none."""
    scan = scanner or Scanner()

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([scan(x.as_py()) for x in texts], ARROW_SPANS)

    return spans(text)


def redacted(text: Column, mark: str = "<secret>", scanner: Scanner | None = None) -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``; null stays null."""
    scan = scanner or Scanner()

    def clean(x: str | None) -> str | None:
        spans = scan(x)
        if not spans:
            return x
        out, at = [], 0
        for s in spans:
            if s["start"] >= at:
                out += [x[at : s["start"]], mark]
            at = max(at, s["end"])
        return "".join([*out, x[at:]])

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        return pa.array([clean(x.as_py()) for x in texts], pa.string())

    return redact(text)


def scan_secrets(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with the spans of ``text`` in ``out`` (a column of that name is replaced); all rows stay.

    Null and empty texts have no spans, repeated rows each get theirs, any other column name is free,
    an empty table stays empty. The time for a text grows with its length, not with its square.
    """
    return df.withColumn(out, secret_spans(F.col(text)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
