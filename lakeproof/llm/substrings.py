"""Removal of repeated substrings: bytes covered by a string of ``LENGTH`` bytes that also starts earlier in the corpus.

Every string of 100 bytes has an anchor, the 16-gram in it with the smallest hash, which is found from the string alone.
So equal strings share their anchor and their offset from it, and strings are compared per anchor only.

1. One scan lists *segments*, the runs of string starts with the same anchor (about one per 43 bytes), as anchor hash and
   content hash. Anchors that occur once drop out. What remains is kept as two bit filters of bounded size: shared
   anchors, and those of them with different contents. A content that comes again within a document (periodic text) is a
   repeat at once; it is passed on as such and never grouped.
2. A second scan writes the segments of shared anchors, with their bytes where contents differ, dealt by anchor. Segments
   with equal contents collapse: all but the first are repeats as a whole. For the others, the texts right and left of
   the anchors are put in order by suffix arrays (``suffix_array``, linear grouping), and a string with r bytes left of its
   anchor equals another if their left texts share r and their right texts 100 - r bytes, which are runs of the two orders.
   The first of each run of runs stays.
3. Anchors with more than ``HOT_ANCHOR`` segments (a line that a third of all documents share) would not fit into one
   task. Their strings are hashed one by one to 128 bits, combined before the shuffle, and joined with their first
   occurrence, which Spark splits where it is skewed. There are at most (segments / ``HOT_ANCHOR``) such anchors.
4. Covered spans are gathered per document and cut out. Texts without any are not shuffled.

Contents of one anchor are taken as equal if their 64-bit hashes are, beside the 64-bit hash of the anchor.

Defined cases: NULL texts count as empty; texts shorter than the length have no repeats; a NULL id is the smallest; rows
with equal id are ordered by a hash of their texts; rows equal in id and text are one document, listed again with the same
result. Bytes are cut wherever strings end, so ``deduplicate`` drops parts of characters at the edges of a cut.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.llm.common import filter_array, filter_words, identified, in_filter, numbered, quoted, text_of, utf8, with_marks
from lakeproof.llm.suffix_array import ranks
from lakeproof.session import materialize

LENGTH = 100
GRAM = 16
#: Anchors with more segments than this are handled string by string.
HOT_ANCHOR = 50_000
#: Texts are scanned in steps of this many bytes; a position within a step fits into the low bits of a key.
STEP = 1 << 19
LOW = np.uint64((1 << 20) - 1)
#: Segments that are put in order at once.
CHUNK = 20_000
#: In place of the bytes left of the anchor: a segment whose content came earlier in its own document.
AGAIN = -1
_BASE = 0x9E3779B97F4A7C15


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 16-grams, by doubling."""
    hashes, size = raw.astype(np.uint64) + np.uint64(1), 1
    while size < GRAM:
        hashes = hashes[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + hashes[size:]
        size *= 2
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(32))


def segments(text: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hashes, first string starts, numbers of strings, bytes from first start to anchor), step by step."""
    window = length - GRAM + 1
    for at in range(0, len(text) - length + 1, STEP):
        raw = np.frombuffer(text, dtype=np.uint8, offset=at, count=min(STEP + length - 1, len(text) - at))
        grams = _gram_hashes(raw)
        # the smallest hash, and of equal ones the first
        least, size = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64), 1
        while 2 * size <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < window:
            least = np.minimum(least[: size - window], least[window - size :])
        anchor = (least & LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        count = np.diff(np.append(first, len(anchor)))
        yield grams[anchor[first]], first + at, count, anchor[first] - first


def _contents(text: bytes, first: np.ndarray, count: np.ndarray, length: int) -> list[bytes]:
    return [text[a:b] for a, b in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)]


def _hash(content: bytes) -> int:
    value = xxhash.xxh3_64_intdigest(content)
    return value - (1 << 64) if value >> 63 else value


def _list_segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, hashes = [], []
            for text in utf8(batch, "text"):
                for anchor, first, count, _ in segments(text, length):
                    found = list(map(_hash, _contents(text, first, count, length)))
                    if len(set(found)) < len(found):  # of a content that comes again and again, two say enough
                        times: Counter[int] = Counter()
                        kept = [k for k, h in enumerate(found) if times.update((h,)) or times[h] <= 2]
                        anchor, found = anchor[kept], [found[k] for k in kept]
                    anchors.append(anchor.view(np.int64))
                    hashes += found
            if anchors:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors)), pa.array(hashes, pa.int64())], names=["anchor", "content"])

    return run


SEGMENTS = pa.schema(
    [("anchor", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("left", pa.int32()), ("bytes", pa.binary())]
)


def _shared_segments(length: int, shared: Broadcast, differing: Broadcast, hot: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in SEGMENTS]
            docs, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, th, text in zip(docs, ths, utf8(batch, "text"), strict=True):
                seen: set[bytes] = set()
                for anchor, first, count, left in segments(text, length):
                    some = np.flatnonzero(in_filter(anchor, shared.value))
                    some = some[~np.isin(anchor[some].view(np.int64), hot.value)]
                    if not len(some):
                        continue
                    contents = _contents(text, first[some], count[some], length)
                    fresh = set(contents)
                    if len(fresh) < len(contents) or not seen.isdisjoint(fresh):
                        new = [c not in seen and not seen.add(c) for c in contents]
                        again = [k for k, n in enumerate(new) if not n]
                        for a, n in _joined(first[some[again]].tolist(), count[some[again]].tolist()):
                            for column, value in zip(columns, (a, 0, doc, th, a, n, AGAIN, None), strict=True):
                                column.append(value)
                        keep = [k for k, n in enumerate(new) if n]
                        some, contents = some[keep], [contents[k] for k in keep]
                    else:
                        seen |= fresh
                    carried = in_filter(anchor[some], differing.value).tolist()
                    parts = (
                        anchor[some].view(np.int64).tolist(), list(map(_hash, contents)), [doc] * len(some), [th] * len(some),
                        first[some].tolist(), count[some].tolist(), left[some].tolist(), [c if k else None for c, k in zip(contents, carried, strict=True)],
                    )
                    for column, part in zip(columns, parts, strict=True):
                        column += part
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SEGMENTS, strict=True)], schema=SEGMENTS)

    return run


def _joined(starts: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """Neighbouring (start, count) as one."""
    out: list[tuple[int, int]] = []
    for start, count in zip(starts, counts, strict=True):
        if out and sum(out[-1]) == start:
            out[-1] = (out[-1][0], out[-1][1] + count)
        else:
            out.append((start, count))
    return out


def _runs(common: np.ndarray, least: int) -> np.ndarray:
    """Numbers of the runs of an order in which neighbours share at least so many bytes."""
    return np.cumsum(common < least)


def repeated_strings(contents: list[bytes], n: np.ndarray, left: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For all strings of segments, in order, whether an earlier segment has the string at the same anchor.

    Segments come in the order of (document, anchor position).
    """
    right_rank, right_common = ranks([c[a:] for c, a in zip(contents, left.tolist(), strict=True)], length)
    left_rank, left_common = ranks([c[:a][::-1] for c, a in zip(contents, left.tolist(), strict=True)], length)
    owner = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    before = left[owner] - offset  # bytes left of the anchor
    out = np.zeros(len(owner), dtype=bool)
    by_offset = np.argsort(before, kind="stable")
    cuts = np.flatnonzero(np.diff(before[by_offset])) + 1
    for at in np.split(by_offset, cuts):
        if len(at) < 2:
            continue
        r = int(before[at[0]])
        right = _runs(right_common, length - r)[right_rank[owner[at]]]
        pair = _runs(left_common, r)[left_rank[owner[at]]] * (int(right.max()) + 1) + right
        repeats = np.ones(len(at), dtype=bool)
        repeats[np.unique(pair, return_index=True)[1]] = False
        out[at] = repeats
    return out


SPANS = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("mark", pa.int64())])


def _mark(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return start << 32 | end


def _resolve(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Repeated spans among the segments of complete anchors, sorted by (anchor, content, doc, th, start)."""
    known = pc.equal(table.column("left"), AGAIN)
    doc, th, start, n = (table.filter(known).column(i).to_numpy().astype(np.int64) for i in (2, 3, 4, 5))
    yield pa.RecordBatch.from_arrays([doc, th, _mark(start, start + n + length - 1)], schema=SPANS)
    table = table.filter(pc.invert(known)).combine_chunks()
    if not table.num_rows:
        return
    anchor, content, doc, th, start, n, left = (table.column(i).to_numpy().astype(np.int64) for i in range(7))
    new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    new_content = new_anchor | np.concatenate(([True], content[1:] != content[:-1]))
    firsts = np.flatnonzero(new_content)
    owner = firsts[np.cumsum(new_content) - 1]
    # a document that is listed again is not a copy of itself
    again = (doc != doc[owner]) | (th != th[owner]) | (start != start[owner])
    yield pa.RecordBatch.from_arrays([doc[again], th[again], _mark(start, start + n + length - 1)[again]], schema=SPANS)
    number = np.cumsum(new_anchor) - 1
    several = np.bincount(number[firsts])[number] > 1
    rest = firsts[several[firsts]]
    groups = number[rest]
    while len(rest):
        cut = len(rest) if len(rest) <= CHUNK else int(np.searchsorted(groups, groups[CHUNK]))
        cut = cut or int(np.searchsorted(groups, groups[0], side="right"))
        part, rest, groups = rest[:cut], rest[cut:], groups[cut:]
        part = part[np.lexsort((start[part] + left[part], th[part], doc[part]))]
        contents = table.column(7).take(pa.array(part)).to_pylist()
        repeats = repeated_strings(contents, n[part], left[part], length)
        owners = np.repeat(part, n[part])
        at = start[owners] + np.arange(len(owners)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        # runs of repeated starts in a segment are one span
        begins = repeats & ~np.concatenate(([False], repeats[:-1] & (owners[1:] == owners[:-1])))
        ends = repeats & ~np.concatenate((repeats[1:] & (owners[1:] == owners[:-1]), [False]))
        yield pa.RecordBatch.from_arrays([doc[owners[begins]], th[owners[begins]], _mark(at[begins], at[ends] + length)], schema=SPANS)


def _resolver(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 4 * CHUNK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            anchors = table.column(0).to_numpy()
            cut = len(anchors) - int(np.argmax(anchors[::-1] != anchors[-1])) if anchors[0] != anchors[-1] else 0
            if cut:
                yield from _resolve(table.slice(0, cut), length)
            rest = table.slice(cut).combine_chunks()
            held, rows = rest.to_batches(), 0 if not cut else rest.num_rows
        if held:
            yield from _resolve(pa.Table.from_batches(held).combine_chunks(), length)

    return run


def _hot_strings(length: int, hot: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, ths, starts = [], [], [], []
            for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch, "text"), strict=True):
                for anchor, first, count, _ in segments(text, length):
                    some = np.isin(anchor.view(np.int64), hot.value)
                    for a, k in zip(first[some].tolist(), count[some].tolist(), strict=True):
                        keys += [xxhash.xxh3_128_digest(text[p : p + length]) for p in range(a, a + k)]
                        docs += [doc] * k
                        ths += [th] * k
                        starts += range(a, a + k)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(docs, pa.int64()), pa.array(ths, pa.int64()), pa.array(starts, pa.int64())], names=["key", "doc", "th", "start"])

    return run


def repeated_spans(rows: DataFrame, length: int = LENGTH, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """(doc, th, mark): repeated spans of rows from ``identified``; a mark is ``start << 32 | end`` in bytes."""
    if not GRAM < length <= 256:
        raise ValueError("the length of a string must be from 17 to 256 bytes")
    context = rows.sparkSession.sparkContext
    texts = rows.filter(F.octet_length("text") >= length)
    listed = texts.select("text").mapInArrow(_list_segments(length), "anchor bigint, content bigint")
    counted = listed.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
    anchors = materialize(counted.filter("n > 1").select("anchor", "n", F.expr("low <> high").alias("differs")))
    # at most (number of segments / hot_anchor) anchors
    hot = context.broadcast(np.array([r["anchor"] for r in anchors.filter(F.col("n") > hot_anchor).select("anchor").collect()], dtype=np.int64))
    shared = context.broadcast(filter_array(*filter_words(anchors.select(F.col("anchor").alias("hash")))))
    differing = context.broadcast(filter_array(*filter_words(anchors.filter("differs").select(F.col("anchor").alias("hash")))))
    found = texts.mapInArrow(
        _shared_segments(length, shared, differing, hot), "anchor bigint, content bigint, doc bigint, th bigint, start bigint, n int, left int, bytes binary"
    )
    dealt = found.repartition("anchor").sortWithinPartitions("anchor", "content", "doc", "th", "start")
    spans = dealt.mapInArrow(_resolver(length), "doc bigint, th bigint, mark bigint")
    if not len(hot.value):
        return spans
    strings = materialize(texts.mapInArrow(_hot_strings(length, hot), "key binary, doc bigint, th bigint, start bigint"))
    place = F.struct("doc", "th", "start")
    first = strings.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first")
    first = materialize(first)  # so that Spark can split a hot key of the join
    later = strings.join(first, "key").filter(place != F.col("first"))
    return spans.unionByName(later.select("doc", "th", (F.shiftleft("start", 32) + F.col("start") + length).alias("mark")))


def merged_marks(marks: list[int] | None) -> list[tuple[int, int]]:
    """Sorted marks as maximal spans."""
    out: list[tuple[int, int]] = []
    for mark in marks or []:
        start, end = mark >> 32, mark & 0xFFFFFFFF
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    out.append(text[at:])
    return b"".join(out)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, counts, digests = [], [], [], []
        for text, marks in zip(utf8(batch, "text"), batch.column("marks").to_pylist(), strict=True):
            spans = merged_marks(marks)
            sizes.append(len(text))
            removed.append(sum(end - start for start, end in spans))
            counts.append(len(spans))
            digests.append(hashlib.sha256(kept_bytes(text, spans)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of ``docs``."""
    spans = repeated_spans(identified(docs, id_col, text_col), **limits)
    rows = docs.select(quoted(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    marked = with_marks(rows, spans, F.coalesce("doc_id", F.lit(-(2**63))), F.xxhash64("text"), "marks")
    return marked.mapInArrow(_report, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with repeated strings cut out of their texts; all columns and rows stay."""
    rows, (id_name, text_name) = numbered(docs, id_col, text_col)
    return _deduplicate(rows, id_name, text_name, **limits).toDF(*docs.columns)


def _deduplicate(docs: DataFrame, id_col: str, text_col: str, **limits) -> DataFrame:
    spans = repeated_spans(identified(docs, id_col, text_col), **limits)
    doc = F.coalesce(quoted(id_col).cast("bigint"), F.lit(-(2**63)))
    marked = with_marks(docs, spans, doc, F.xxhash64(text_of(text_col)), "\u0001spans")
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = map(merged_marks, batch.column(batch.num_columns - 1).to_pylist())
            texts = [None if t is None else kept_bytes(t, s).decode(errors="ignore") for t, s in zip(utf8(batch, text_col), spans, strict=True)]
            field = batch.schema.field(at)
            yield batch.select(range(batch.num_columns - 1)).set_column(at, field, pa.array(texts, field.type))

    return marked.mapInArrow(cut, docs.schema)


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The report of documents with distinct ids by looking up every string; for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(docs):
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            string = raw[p : p + length]
            if string in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(string)
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        spans = sum(1 for k, c in enumerate(covered) if c and (not k or not covered[k - 1]))
        out[doc] = (len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out
