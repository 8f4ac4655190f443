"""Spelling variants: words that are one edit apart, and the commonest form of each.

The vocabulary's acceptor is composed with a one-edit transducer and the acceptor again, partition by partition. A partition
is a window of the edit: pairs whose shorter word has m symbols and whose edit stands at symbols a to b share the a symbols before and the
m - b symbols behind, so the words with that beginning and end are one partition, with the state after the beginning as its
initial state and the one before the end as its final state. Every word goes to the partitions of its two halves, as the shorter and as
the longer word of a pair. A pair is accepted in one partition alone, the one with the place where both words first differ.

1. Words are counted per task in a bounded table, then in a shuffle.
2. Partitions with more than ``PARTITION_CHARS`` symbols in their words' windows (a beginning or end that many words share) are cut: the
   window is halved, as often as needed, down to a single symbol. What is left then differs in two symbols at most, so there are a
   few thousand words of it, as letters are few.
3. In each partition the acceptors are built and minimised, and the accepted pairs of the composition are listed.
4. A word's form is its most frequent near word, if that is ``RATIO`` times as frequent. Forms are followed to the last by
   pointer doubling, in rounds that grow with the logarithm of the longest chain (frequencies double, so chains are short).

Nothing is dropped: partitions only lose words that are alone in them. Keys of partitions are hashed; the words of a partition are
compared by their actual beginnings and ends.

Defined cases: NULL and empty texts have no words; a NULL id is an empty string where a rule needs it; repeated rows count as
often as they come; words may be of any length; ties go to the smallest word in code-point order; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.llm.automaton import one_edit_pairs
from lakeproof.llm.common import quoted, utf8
from lakeproof.session import discard, facts, materialize

SHORTEST = 5
LEAST = 3
RATIO = 2
PARTITION_CHARS = 1 << 16
#: Distinct words that a task counts before it hands them on.
TASK_WORDS = 200_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

Rule = Callable[[int | None, dict[str, int]], dict[str, int]]


def count_words(docs: DataFrame, id_col: str, text_col: str, shortest: int, rule: Rule | None) -> DataFrame:
    """(word, n): occurrences of runs of letters, lower-cased for A-Z. ``rule`` changes the counts of a text."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch, "text"), strict=True):
                if not text:
                    continue
                found = Counter(runs.findall(text.translate(_LOWER).decode()))
                counts.update(rule(doc, found) if rule is not None else found)
                if len(counts) >= TASK_WORDS:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    rows = docs.select(quoted(id_col).cast("bigint").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


WINDOW = ["m", "a", "b", "key"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows of (m, a, b, word, n) with the key of what the words of a partition share."""
    begin, end = F.substring("word", F.lit(1), F.col("a")), F.expr("substring(word, length(word) - (m - b) + 1, m - b)")
    return rows.select("m", "a", "b", F.xxhash64(begin, end).alias("key"), "word", "n")


def _windows(words: DataFrame, shortest: int) -> DataFrame:
    """Each word in the two halves, as the shorter and as the longer word of a pair."""
    lengths = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda m: m >= shortest)
    rows = words.select("word", "n", F.explode(lengths).alias("m"))
    half = F.expr("m div 2").cast("int")
    halves = F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), F.col("m").alias("b")))
    return _keyed(rows.select("word", "n", "m", F.explode(halves).alias("w")).select("word", "n", "m", "w.a", "w.b"))


def _cut(rows: DataFrame) -> DataFrame:
    """Each word in the two halves of its window."""
    middle = F.expr("(a + b) div 2").cast("int")
    halves = F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b"))
    return _keyed(rows.select("word", "n", "m", F.explode(halves).alias("w")).select("word", "n", "m", "w.a", "w.b"))


def partitions(words: DataFrame, shortest: int = SHORTEST, partition_chars: int = PARTITION_CHARS) -> DataFrame:
    """(m, a, b, key, words): the words (word, n) of each partition that has at least two."""
    rows, done = _windows(words, shortest), []
    while True:
        sizes = rows.groupBy(*WINDOW).agg(F.count("*").alias("members"))
        width = F.col("b") - F.col("a")
        large = materialize(sizes.filter((F.col("members") * width > partition_chars) & (width > 1)).select(*WINDOW))
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, WINDOW, "left_anti"))
        rows = materialize(_cut(rows.join(large, WINDOW, "left_semi")))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    listed = every.groupBy(*WINDOW).agg(F.collect_list(F.struct("word", "n")).alias("words"))
    return listed.filter(F.size("words") > 1)


PAIRS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of the pairs of each partition."""
    for batch in batches:
        out: tuple[list, list, list] = [], [], []
        ms, starts, ends = (batch.column(c).to_pylist() for c in range(3))
        lists = batch.column(4)
        for row, (m, a, b) in enumerate(zip(ms, starts, ends, strict=True)):
            members = lists[row].values
            names, counts = members.field(0).to_pylist(), members.field(1).to_pylist()
            n_of = dict(zip(names, counts, strict=True))
            shared: dict[tuple[str, str], tuple[list, list]] = {}
            for word in names:
                size = len(word)
                cut = size - (m - b)
                shared.setdefault((word[:a], word[cut:]), ([], []))[size - m].append(word[a:cut])
            for (begin, end), (words, longer) in shared.items():
                if not words or len(words) + len(longer) < 2:
                    continue
                words.sort()
                longer.sort()
                for x, y in one_edit_pairs(words, longer, b == m):
                    x, y = begin + x + end, begin + y + end
                    out[0].extend((x, y))
                    out[1].extend((y, x))
                    out[2].extend((n_of[y], n_of[x]))
            if len(out[0]) >= 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PAIRS, strict=True)], schema=PAIRS)
                out = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PAIRS, strict=True)], schema=PAIRS)


def near_pairs(words: DataFrame, shortest: int = SHORTEST, partition_chars: int = PARTITION_CHARS) -> DataFrame:
    """(word, near, near_n): every pair of the words (word, n) that are one edit apart, in both directions."""
    listed = partitions(words, shortest, partition_chars).select("m", "a", "b", "key", "words")
    return listed.mapInArrow(_compose, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by pointer doubling."""
    table = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = table.select(F.col("word").alias("mid"), F.col("root").alias("next"))
        moved = table.join(ahead, table["root"] == ahead["mid"], "left")
        moved = moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        new = materialize(moved, moves=F.count_if("moved"))
        discard(table)
        table = new.select("word", "root")
        if not facts(new)["moves"]:
            return table


def report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO,
    rule: Rule | None = None, partition_chars: int = PARTITION_CHARS,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of at least ``shortest`` symbols and ``least`` occurrences."""
    counted = count_words(docs, id_col, text_col, shortest, rule)
    words = materialize(counted.filter((F.length("word") >= shortest) & (F.col("n") >= least)))
    pairs = near_pairs(words, shortest, partition_chars)
    none = F.lit(None)
    every = words.select("word", "n", none.cast("string").alias("near"), none.cast("bigint").alias("near_n")).unionByName(
        pairs.select("word", none.cast("bigint").alias("n"), "near", "near_n")
    )
    first = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))).alias("first")
    judged = every.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), first)
    follows = -F.col("first.less") >= ratio * F.col("n")
    judged = judged.select(
        "word", F.when(follows, F.col("first.near")).alias("form"), "n", "n_near", F.when(follows, -F.col("first.less")).alias("form_n")
    )
    judged = materialize(judged)
    last = roots(judged.filter("form is not null")).select(F.col("word").alias("follower"), "root")
    out = judged.join(last, judged["word"] == last["follower"], "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

