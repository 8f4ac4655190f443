"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Fixed kinds are assignments to secret names, access keys and hex keys. Beside them every run of 20 or more characters of keys
is a candidate. Its class (hex digits, letters and digits of both or one case, base64) says how surprising a window of
it must be: a window moves over the candidate, the counts of its characters are updated by the one that enters and the
one that leaves, and with them the sum of c log c, so a step costs the same for any window. Windows above the class's
threshold are merged to spans. The allow-list drops what is known not to be a secret: candidates and spans that are UUIDs,
words, paths or numbers as a whole, and windows that hold part of an example's word or of a sequence. So a word excuses
its own place and not the run it stands in. No span of the fixed kinds is ever dropped.

Texts without any of the needed characters are passed over by searches in their bytes. One pass, no shuffle.

Defined cases: NULL texts count as empty and have no spans; repeated rows get a row each; positions are code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lakeproof.llm.common import numbered, quoted, utf8

# Patterns of the kinds, in their order, and what a match needs.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
#: Bits per character that a window of a class must exceed. A window of 20 characters has at most log2(20) = 4.32.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+"), 3.0),
    ("lower", re.compile(r"[0-9a-z]+"), 3.6),
    ("upper", re.compile(r"[0-9A-Z]+"), 3.6),
    ("alphanumeric", re.compile(r"[0-9A-Za-z]+"), 3.8),
    ("base64", re.compile(r"[0-9A-Za-z+/=_-]+"), 3.9),
)
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),  # UUIDs
    re.compile(r"[A-Za-z]+(?:[-_/=+][A-Za-z]+)*[-_/=+]*"),  # words, names and paths of words
    re.compile(r"[0-9]+(?:[-_/][0-9]+)*"),  # numbers and dates
)
#: Words of examples, and sequences. They excuse the windows that they are part of, and nothing beside them.
ALLOWED_WORDS = re.compile(r"(?i)example|sample|dummy|placeholder|xxxx|abcdefghij|0123456789")

_KEY_RUNS = bytes(1 if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/=_-") else 0 for c in range(256))
_HEX_RUNS = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))
_NAMES = (b"passw", b"secret", b"token", b"api_key", b"apikey")


def window_entropies(text: str, window: int = WINDOW) -> Iterator[float]:
    """Shannon entropy of every window in bits per character, by counts updated step by step."""
    counts: dict[str, int] = {}
    total = 0.0  # sum of c log2 c

    def xlogx(n: int) -> float:
        return n * math.log2(n) if n else 0.0

    for at, char in enumerate(text):
        n = counts.get(char, 0)
        total += xlogx(n + 1) - xlogx(n)
        counts[char] = n + 1
        if at >= window:
            gone = text[at - window]
            n = counts[gone]
            total += xlogx(n - 1) - xlogx(n)
            counts[gone] = n - 1
        if at >= window - 1:
            yield math.log2(window) - total / window


def surprising(text: str) -> Iterator[tuple[int, int]]:
    """Spans of a candidate whose windows exceed the threshold of its class, unless allowed."""
    threshold = next(bits for _, pattern, bits in CLASSES if pattern.fullmatch(text))
    excused = {at for m in ALLOWED_WORDS.finditer(text) for at in range(m.start() - WINDOW + 1, m.end())}
    start = end = -1
    spans = []
    for at, bits in enumerate(window_entropies(text)):
        if bits <= threshold or at in excused:
            continue
        if at <= end:
            end = at + WINDOW
        else:
            if end > 0:
                spans.append((start, end))
            start, end = at, at + WINDOW
    if end > 0:
        spans.append((start, end))
    for start, end in spans:
        if not any(rule.fullmatch(text[start:end]) for rule in ALLOWED):
            yield start, end


def spans_of(raw: bytes | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of the kinds."""
    if not raw:
        return []
    low = raw.lower()
    named = any(name in low for name in _NAMES)
    key = b"\1" * WINDOW in raw.translate(_KEY_RUNS)
    access = b"AKIA" in raw
    hexes = b"\1" * HEX_LENGTH in raw.translate(_HEX_RUNS)
    if not (named or key or access or hexes):
        return []
    text = raw.decode()
    found = []
    if named:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if access:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    if hexes:
        found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= HEX_LENGTH]
    if key:
        for m in CANDIDATE.finditer(text):
            if not any(rule.fullmatch(m[0]) for rule in ALLOWED):
                found += [("entropy", m.start() + a, m.start() + b) for a, b in surprising(m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = [spans_of(t) for t in utf8(batch, "text")]
        counts = [[sum(1 for s in spans if s[0] == kind) for spans in every] for kind in KINDS[:3]]
        digests = [hashlib.sha256(written([s for s in spans if s[0] != "entropy"]).encode()).hexdigest() for spans in every]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array([written(s) for s in every], pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row per row of ``docs``."""
    rows = docs.select(quoted(id_col).cast("bigint").alias("doc_id"), quoted(text_col).alias("text"))
    return rows.mapInArrow(_report, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with a mark in place of every found span; overlapping spans get one mark. All columns and rows stay."""
    rows, (text_name,) = numbered(docs, text_col)
    return _redact(rows, text_name, mark).toDF(*docs.columns)


def _redact(docs: DataFrame, text_col: str, mark: str) -> DataFrame:
    def cut(raw: bytes | None) -> str | None:
        spans = spans_of(raw)
        if not spans:
            return None if raw is None else raw.decode()
        text, out, at = raw.decode(), [], 0
        for _, start, end in spans:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            field = batch.schema.field(at)
            yield batch.set_column(at, field, pa.array([cut(t) for t in utf8(batch, text_col)], field.type))

    return docs.mapInArrow(run, docs.schema)
