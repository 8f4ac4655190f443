"""Benchmark decontamination: documents that repeat passages of test items.

The items' n-grams of normalised words are broadcast as a hash set. A scan over the documents hashes every n-gram of a text
at once, and compares the words themselves wherever a hash is in the set. Hits are merged to spans of words, which are
removed, or the document is.

An item shorter than a window, but not empty, is one window. The set is built per slice of the items: the number of
slices follows from the size of the benchmark, so that a slice holds half of ``SLICE_CHARS`` characters on average, and
longer items are cut into pieces that overlap by a window less a word. A larger benchmark takes more scans, and their hits
are united. A slice is built, broadcast, scanned and released before the next, so the benchmark is never held whole.

Defined cases: a NULL or empty text has no words, no hit, and is not contaminated; a NULL item has no window; items with
equal ids count once; an item without id marks words but is not named; repeated documents each get their own row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.llm.common import batch_of, numbered, quoted, utf8
from lakeproof.session import materialize

WINDOW = 13
SLICE_CHARS = 16_000_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Of a document's words, one in so many must be hit for it to count as contaminated.
SHARE = 20
_BASE = 0x9E3779B97F4A7C15

SCAN = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def words_of(text: bytes | None) -> list[bytes]:
    """Normalised words: A-Z in lower case; letters and digits of ASCII and everything beyond ASCII belong to words."""
    return WORD.findall(text.lower()) if text else []


class Windows:
    """Windows of a slice of items: all words as one array of numbers, and by length the windows' places, sorted by hash.

    Besides the words themselves that is some twenty bytes a word.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int = WINDOW) -> None:
        self.ids: dict[bytes, int] = {}
        self.names: list[str | None] = []
        parts, sizes = [], []
        for name, text in items:
            words = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)], dtype=np.uint32)
            if len(words):
                parts.append(words)
                sizes.append(len(words))
                self.names.append(name)
        self.words = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        del parts
        self.ends = np.cumsum(np.array(sizes, dtype=np.int64))
        self.by_length: list[tuple[int, np.ndarray, np.ndarray]] = []
        lengths = np.minimum(np.array(sizes, dtype=np.int64), n)
        for size in np.unique(lengths).tolist():
            # an item shorter than a window is one by itself
            hashes = _roll(self.words, size)
            at = np.flatnonzero(lengths == size)
            inside = np.zeros(len(self.words) + 1, dtype=np.int8)
            np.add.at(inside, self.ends[at] - np.array(sizes)[at], 1)
            np.add.at(inside, self.ends[at] - size + 1, -1)
            places = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
            hashes = hashes[places]
            order = np.argsort(hashes, kind="stable")
            self.by_length.append((size, hashes[order], places[order].astype(np.int32 if len(self.words) < 1 << 31 else np.int64)))
        self._owners: dict[tuple[int, int], list[tuple[np.ndarray, frozenset]]] = {}

    def _same_hash(self, size: int, first: int, hashes: np.ndarray, places: np.ndarray) -> list[tuple[np.ndarray, frozenset]]:
        """The distinct windows from a place in the order of hashes, with their items; kept for windows that were met."""
        found = self._owners.get((size, first))
        if found is None:
            last = int(np.searchsorted(hashes, hashes[first], side="right"))
            windows = self.words[places[first:last, None] + np.arange(size)]
            item = np.searchsorted(self.ends, places[first:last], side="right")
            kinds, number = np.unique(windows, axis=0, return_inverse=True)
            number = number.reshape(-1)
            found = [(kind, frozenset(self.names[i] for i in np.unique(item[number == k]).tolist())) for k, kind in enumerate(kinds)]
            self._owners[(size, first)] = found
        return found

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans [start, end) inside occurrences of windows, and the items these windows belong to."""
        known = np.fromiter((self.ids.get(w, 0) for w in words), dtype=np.uint32, count=len(words))
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        for size, hashes, places in self.by_length:
            if size > len(known):
                continue
            rolled = _roll(known, size)
            at = np.searchsorted(hashes, rolled)
            at[at == len(hashes)] = 0
            for start in np.flatnonzero(hashes[at] == rolled).tolist():
                for window, owners in self._same_hash(size, int(at[start]), hashes, places):
                    if np.array_equal(window, known[start : start + size]):  # the words decide
                        found.append((start, start + size))
                        items |= owners
        return merged(found), items


def _roll(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` word numbers."""
    count = max(len(ids) - size + 1, 0)
    out = np.zeros(count, dtype=np.uint64)
    for j in range(size):
        out *= np.uint64(_BASE)
        out += ids[j : j + count]
        out += np.uint64(1)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


#: Pieces of long items are a fraction of a slice, so that slices are even.
PIECES_PER_SLICE = 16
ITEMS = pa.schema([("item", pa.string()), ("text", pa.binary())])


def pieces(text: bytes, limit: int, n: int = WINDOW) -> Iterator[bytes]:
    """A text, or its words in pieces of about ``limit`` bytes which together have the text's windows of ``n`` words.

    A piece has at least 2 n words, the last one n, so overlaps at most double the text, and no piece is taken for a short item.
    """
    if len(text) <= limit:
        yield text
        return
    words = words_of(text)
    start, size = 0, 0
    for end, word in enumerate(words, 1):
        size += len(word) + 1
        if size >= limit and end - start >= 2 * n or end == len(words):
            yield b" ".join(words[start:end])
            start = end - n + 1
            size = sum(len(w) + 1 for w in words[start:end])


def _cut(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(item, piece) for item, text in zip(batch.column(0).to_pylist(), utf8(batch, "text"), strict=True) for piece in pieces(text, limit)]
            yield batch_of(ITEMS, zip(*rows, strict=True) if rows else ([], []))

    return run


def _slices(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> tuple[int, Iterator[Windows]]:
    """The number of slices, and the windows of each, which are built when it is asked for."""
    items = benchmark.select(quoted(item_col).cast("string").alias("item"), quoted(text_col).cast("binary").alias("text")).filter("text is not null")
    total = int(benchmark.agg(F.coalesce(F.sum(F.length(quoted(text_col))), F.lit(0)).alias("n")).first()["n"])
    count = 1
    if total > limit:
        items = materialize(items.mapInArrow(_cut(max(1, limit // PIECES_PER_SLICE)), "item string, text binary").distinct())
        size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
        count = max(2, -(-2 * int(size) // limit))
    share = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    return count, (Windows([(r["item"], bytes(r["text"])) for r in items.filter(share == k).toLocalIterator()]) for k in range(count))


def _scanner(shared, text_col: str, id_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col))
            counts, spans, items = [], [], []
            for text in utf8(batch, text_col):
                words = words_of(text)
                found, owners = windows.hits(words) if words else ([], set())
                counts.append(len(words))
                spans.append([x for span in found for x in span])
                items.append(sorted(x for x in owners if x is not None))
            yield batch_of(SCAN, [ids.to_pylist(), counts, spans, items])

    return scan


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(doc_id, n_words, spans, items): per document the merged hit spans, as flat pairs of word numbers, and the items."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    schema = "doc_id bigint, n_words bigint, spans array<bigint>, items array<string>"
    context = docs.sparkSession.sparkContext
    count, slices = _slices(benchmark, item_col, item_text, slice_chars)
    if count == 1:
        return rows.mapInArrow(_scanner(context.broadcast(next(slices)), "text", "doc_id"), schema)
    united = _scan_slices(rows, slices)
    return united.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "n_words", "spans", "items").mapInArrow(
        _merge_spans, schema
    )


def _scan_slices(rows: DataFrame, slices: Iterator[Windows]) -> DataFrame:
    """(doc_id, h, n_words, spans, items, copies): hits of all slices; ``spans`` holds a list per slice with hits.

    Rows are told apart by id and text while the scans are united; equal rows have equal results and are counted. The
    slices are scanned one after the other, and of the first all rows are kept, of the others those with hits.
    """
    context = rows.sparkSession.sparkContext
    rows = rows.withColumn("h", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    schema = "doc_id bigint, n_words bigint, spans array<bigint>, items array<string>, h binary"
    parts = []
    for windows in slices:
        shared = context.broadcast(windows)
        del windows
        found = rows.mapInArrow(_keyed_scanner(shared), schema)
        parts.append(materialize((found.filter(F.size("spans") > 0) if parts else found).withColumn("first", F.lit(not parts))))
        shared.destroy()
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("doc_id", "h").agg(
        F.first("n_words").alias("n_words"),
        F.collect_set(F.when(F.size("spans") > 0, F.col("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count_if("first").alias("copies"),
    )


def _keyed_scanner(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _scanner(shared, "text", "doc_id")(iter([batch])):
                yield found.append_column("h", batch.column("h"))

    return scan


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [
            [x for span in merged([(s[i], s[i + 1]) for s in lists for i in range(0, len(s), 2)]) for x in span]
            for lists in batch.column("spans").to_pylist()
        ]
        yield batch_of(SCAN, [batch.column("doc_id").to_pylist(), batch.column("n_words").to_pylist(), spans, batch.column("items").to_pylist()])


def report(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per document."""
    n_hit = F.aggregate(
        F.transform(F.col("spans"), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
    return scan(docs, benchmark, **names).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _is_contaminated(n_words: int, spans: list[tuple[int, int]], share: int = SHARE) -> bool:
    n_hit = sum(end - start for start, end in spans)
    return n_hit > 0 and share * n_hit >= n_words


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between the words of a span."""
    if not spans:
        return text
    places = [m.span() for m in WORD.finditer(text.lower())]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    out.append(text[at:])
    return b"".join(out)


def _cleaned(batch: pa.RecordBatch, text_col: str, tokens: list[int], spans: list[list[tuple[int, int]]], remove: str) -> pa.RecordBatch:
    if remove == "documents":
        return batch.filter(pa.array([not _is_contaminated(n, s) for n, s in zip(tokens, spans, strict=True)], type=pa.bool_()))
    at = batch.schema.get_field_index(text_col)
    cut = [None if t is None else without_spans(t, s) for t, s in zip(utf8(batch, text_col), spans, strict=True)]
    field = batch.schema.field(at)
    return batch.set_column(at, field, pa.array(cut, type=pa.binary()).cast(pa.string()).cast(field.type))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", remove: str = "documents", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``docs`` without contaminated documents, or with all documents but without the hit spans (``remove="spans"``).

    All columns are kept. With one slice of items this is one pass without a shuffle. With more, the slices' hits are
    united per document before its share of hit words is judged.
    """
    rows, (id_name, text_name) = numbered(docs, id_col, text_col)
    return _decontaminate(rows, benchmark, id_name, text_name, item_col, item_text, remove, slice_chars).toDF(*docs.columns)


def _decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, remove: str, slice_chars: int) -> DataFrame:
    count, slices = _slices(benchmark, item_col, item_text, slice_chars)
    if count == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(slices))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for batch in batches:
                tokens = [words_of(t) for t in utf8(batch, text_col)]
                spans = [windows.hits(w)[0] if w else [] for w in tokens]
                yield _cleaned(batch, text_col, [len(w) for w in tokens], spans, remove)

        return docs.mapInArrow(apply, docs.schema)

    found = _scan_slices(docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")), slices)
    found = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("\u0001id"), F.col("h").alias("\u0001h"), F.col("spans").alias("\u0001spans"), F.col("n_words").alias("\u0001n"))
    same = quoted(id_col).eqNullSafe(quoted("\u0001id")) & (F.unhex(F.md5(F.coalesce(quoted(text_col), F.lit("")))) == quoted("\u0001h"))

    def apply_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged([(s[i], s[i + 1]) for s in lists or [] for i in range(0, len(s), 2)]) for lists in batch.column(batch.num_columns - 2).to_pylist()]
            tokens = [n or 0 for n in batch.column(batch.num_columns - 1).to_pylist()]
            yield _cleaned(batch.select(range(batch.num_columns - 4)), text_col, tokens, spans, remove)

    return docs.join(found, same, "left").mapInArrow(apply_found, docs.schema)


def brute_force(text: str | None, items: list[tuple[str, str | None]], n: int = WINDOW) -> tuple[int, int, list[str], str]:
    """(n_words, n_hit, items, digest) of one text by comparing every window with every place; for tests."""
    words = words_of(None if text is None else text.encode())
    hit, owners = set(), set()
    for name, item in items:
        own = words_of(None if item is None else item.encode())
        size = min(n, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[i : i + size]:
                    hit |= set(range(at, at + size))
                    owners.add(name)
    names = sorted(owners)
    return len(words), len(hit), names, hashlib.sha256(",".join(names).encode()).hexdigest()
