"""Periodic runs of words, by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least ``max(SHORTEST, 4 q)``
words that no neighbouring word extends. For each k, the runs with periods from b = 2^k to 2b - 1 are found from the blocks
of b words that start at multiples of b:

1. Every such run holds a block that comes again q words later, within the run. So all occurrences of a block that start
   from b to 2b - 1 words after it are asked for: a range successor in a wavelet tree over the suffix array, in the slots of
   the suffixes that begin with the block.
2. These occurrences start within b words of each other, so they are one progression. A single one is q words away, if the block is in a
   run. If there are several, their difference d is the block's own period; the run is not d-periodic as a whole, so the ends
   of the d-periodic stretches around the block and around its occurrence are q words apart.
3. Each candidate is extended to both sides by comparing dyadic blocks, and kept if it is long enough. Candidates with
   the same ends are one run, and the smallest of their periods is its period.

Period 1 needs no tree: the only place to look at is the next word. A run holds three occurrences of its block (six for
period 1), so blocks with fewer in their text are left out, and the tree is built over the others alone.

Texts are searched together in lots of ``LOT_WORDS`` words; words of different texts are different symbols, so nothing crosses
texts. Memory follows the lot, or the longest text: about 500 bytes a word.

Defined cases: a NULL text has no words; a NULL id is the empty string where a rule needs it; rows are reported as often as
they come, each by itself; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.llm.common import quoted, utf8
from lakeproof.llm.wavelet import Blocks, WaveletTree

SHORTEST = 6
POWERS = 4
LOT_WORDS = 1 << 17

Words = list[bytes]
Rule = Callable[[int | None, Words], Words]


def symbols_of(texts: list[Words]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, first place of each text): one number per word and text, and a number of its own after each text."""
    sizes = np.array([len(words) for words in texts], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    every = pa.array([w for words in texts for w in words], pa.large_binary()).dictionary_encode()
    kinds = len(every.dictionary) + 1
    symbols = np.repeat(np.arange(len(texts), dtype=np.int64) * kinds, sizes + 1)
    inside = np.ones(len(symbols), dtype=bool)
    inside[ends - 1] = False
    symbols[inside] += every.indices.to_numpy()
    symbols[~inside] += kinds - 1
    return symbols, ends - sizes - 1


def _ones(symbols: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of period 1: stretches of one word."""
    cuts = np.concatenate(([0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1, [len(symbols)]))
    long = np.diff(cuts) >= shortest
    return cuts[:-1][long], cuts[1:][long], np.ones(int(long.sum()), dtype=np.int64)


def _candidates(blocks: Blocks, tree: WaveletTree, slots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of all blocks of length 2^k whose occurrences allow a run."""
    length, n = 1 << k, len(blocks.order)
    at = np.arange(0, n, length, dtype=np.int64)
    name = blocks.names[k][at]
    size = blocks.sizes[k][name]
    often = size >= POWERS - 1
    at, low, high = at[often], slots[name[often]], slots[name[often] + size[often]]
    near = tree.successor(low, high, at + length)
    found = (near >= 0) & (near < at + 2 * length)
    at, low, high, near = at[found], low[found], high[found], near[found]
    following = tree.successor(low, high, near + 1)
    several = (following >= 0) & (following < at + 2 * length)
    places, periods = [at], [near - at]
    if several.any():
        a, b, step = at[several], near[several], following[several] - near[several]
        places += [a, a]
        periods.append(b - a + blocks.common_after(b, b + step) - blocks.common_after(a, a + step))
        periods.append(b - a - blocks.common_before(b, b + step) + blocks.common_before(a, a + step))
    at, period = np.concatenate(places), np.concatenate(periods)
    fits = (period >= length) & (period < 2 * length) & (at + period < n)
    return at[fits], period[fits]


def runs_of(symbols: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs by start and then period; the sequence ends with a symbol of its own."""
    found = [_ones(symbols, shortest)]
    blocks = Blocks(symbols)
    if len(blocks.names) > 1:
        # blocks of two words or more are asked for in slots of these suffixes only
        often = blocks.sizes[1][blocks.names[1][blocks.order]] >= POWERS - 1
        slots = np.concatenate(([0], np.cumsum(often)))
        tree = WaveletTree(blocks.order[often])
        for k in range(1, len(blocks.names)):
            at, period = _candidates(blocks, tree, slots, k)
            start = at - blocks.common_before(at, at + period)
            end = at + period + blocks.common_after(at, at + period)
            long = end - start >= np.maximum(shortest, POWERS * period)
            found.append((start[long], end[long], period[long]))
    start, end, period = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.ones(len(start), dtype=bool)
    smallest[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


Run = tuple[int, int, int]


def runs_of_texts(texts: list[Words]) -> list[list[Run]]:
    """(start, length, period) of the runs of each text, by start and then period."""
    out: list[list[Run]] = [[] for _ in texts]
    if not any(texts):
        return out
    symbols, first = symbols_of(texts)
    start, end, period = runs_of(symbols)
    text = np.searchsorted(first, start, side="right") - 1
    for t, s, e, p in zip(text.tolist(), (start - first[text]).tolist(), (end - first[text]).tolist(), period.tolist(), strict=True):
        out[t].append((s, e - s, p))
    return out


def collapsed(words: Words, runs: list[Run]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if runs:
        keep = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = list(compress(words, keep.tolist()))
    return b" ".join(words)


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period; of equal ones the first by start and then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _lots(batches: Iterator[pa.RecordBatch], text_at: str, rule: Rule | None, id_at: str | None) -> Iterator[tuple[pa.RecordBatch, list[Words], list[list[Run]]]]:
    """Slices of the batches with the words and runs of their texts."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(id_at)).to_pylist() if id_at else [None] * batch.num_rows
        lot, begin, total = [], 0, 0
        for row, (doc, text) in enumerate(zip(ids, utf8(batch, text_at), strict=True)):
            words = text.split() if text else []
            lot.append(rule(doc, words) if rule is not None else words)
            total += len(words)
            if total >= LOT_WORDS:
                yield batch.slice(begin, row + 1 - begin), lot, runs_of_texts(lot)
                lot, begin, total = [], row + 1, 0
        if lot:
            yield batch.slice(begin), lot, runs_of_texts(lot)


REPORT = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, "
    "collapsed_sha256 string, n_words bigint, n_kept bigint"
)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule | None = None) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words, n_kept), one row per row of ``docs``.

    ``rule`` changes a text's words before the search.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, found in _lots(batches, "text", rule, "doc_id"):
            rows = []
            for words, runs in zip(texts, found, strict=True):
                best = strongest(runs)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                kept = collapsed(words, runs)
                rows.append((
                    len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
                    hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), len(words), kept.count(b" ") + bool(kept),
                ))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]], names=[c.split()[0] for c in REPORT.split(", ")]
            )

    rows = docs.select(quoted(id_col).cast("bigint").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, REPORT)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, period): one row per run, in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, found in _lots(batches, "text", None, None):
            counts = [len(runs) for runs in found]
            rows = [r for runs in found for r in runs]
            at = pa.array(np.repeat(np.arange(len(found)), counts))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), *[pa.array([r[c] for r in rows], pa.int64()) for c in range(3)]], names=["doc_id", "start", "length", "period"]
            )

    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id", *[F.lit(0).cast("bigint").alias(c) for c in ("start", "length", "period")]).schema)


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each run cut down to its first period; texts without runs stay as they are. All columns and rows stay."""
    at = docs.columns.index(text_col)
    names = [f"c{k}" for k in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, found in _lots(batches, names[at], None, None):
            old = utf8(part, names[at])
            new = [collapsed(words, runs) if runs else text for words, runs, text in zip(texts, found, old, strict=True)]
            field = part.schema.field(at)
            yield part.set_column(at, field, pa.array(new, pa.large_binary()).cast(pa.large_string()).cast(field.type))

    numbered = docs.toDF(*names)
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
