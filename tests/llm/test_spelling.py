from __future__ import annotations

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lakeproof.llm import automaton, queries, spelling
from tests.llm import cases


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def near_of(words):
    """Near words by the texts with one symbol deleted or replaced by a mark."""
    by_key = defaultdict(set)
    for w in words:
        by_key[w].add(w)
        for i in range(len(w)):
            by_key[w[:i] + w[i + 1 :]].add(w)
            by_key[w[:i] + "*" + w[i + 1 :]].add(w)
    found = defaultdict(set)
    for group in by_key.values():
        for x in group:
            found[x] |= {y for y in group if x != y and near(x, y)}
    return found


def contract(doc, word):
    h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
    return word if h % 97 else word[: h % len(word)] + word[h % len(word) + 1 :]


def expected(pairs, edit=lambda doc, word: word, shortest=5, least=3, ratio=2):
    counts = Counter()
    for doc, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            counts[edit(doc, "".join(c.lower() if "A" <= c <= "Z" else c for c in run))] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    others, forms = near_of(counts), {}
    for word, n in counts.items():
        if others[word]:
            best = min(others[word], key=lambda y: (-counts[y], y))
            if counts[best] >= ratio * n:
                forms[word] = best
    out = []
    for word, n in counts.items():
        root = word
        while root in forms:
            root = forms[root]
        out.append((word, forms.get(word), root, n, len(others[word]), counts[forms[word]] if word in forms else None))
    return sorted(out)


@pytest.mark.parametrize("at_end", [True, False])
def test_composition(at_end):
    rnd = random.Random(3)
    for _ in range(800):
        length, letters = rnd.randint(0, 5), "abc"[: rnd.choice([1, 2, 3])]
        words = sorted({"".join(rnd.choice(letters) for _ in range(length)) for _ in range(rnd.randint(1, 30))})
        longer = sorted({"".join(rnd.choice(letters) for _ in range(length + 1)) for _ in range(rnd.randint(0, 30))})
        got = list(automaton.one_edit_pairs(words, longer, at_end))
        want = {(x, y) for i, x in enumerate(words) for y in words[i + 1 :] if near(x, y)}
        want |= {(x, y) for x in words for y in longer if near(x, y) and (at_end or y[:-1] != x)}
        assert len(got) == len(set(got)) and set(got) == want


def test_acceptors_are_minimal():
    words = sorted(a + b + c for a in "abc" for b in "de" for c in ("xy", "zz"))
    acceptors = automaton.Acceptors()
    start = acceptors.add(words)
    assert acceptors.size[start] == len(words) and sorted(acceptors.common(start, start)) == words
    assert len(acceptors.edges) == 6  # the end, before y, before z, and one for each of the three letters before


def vocabulary(seed=5):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(5, 9))) for _ in range(400)}
    words |= {"shared" + "".join(rnd.choice("abcdéß") for _ in range(rnd.randint(1, 4))) for _ in range(300)}
    words |= {"x" * n for n in range(5, 30)} | {"q" * 3_000, "q" * 3_001, "q" * 1_400 + "é" + "q" * 1_600}
    return {w: rnd.randint(3, 400) for w in words}


@pytest.mark.parametrize("partition_chars", [spelling.PARTITION_CHARS, 2_000, 100])
def test_near_pairs(spark, partition_chars):
    counts = vocabulary()
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = [tuple(r) for r in spelling.near_pairs(words, partition_chars=partition_chars).collect()]
    short = near_of({w for w in counts if len(w) < 100})
    q = sorted((w for w in counts if len(w) > 100), key=len)
    pairs = {(x, y) for x, ys in short.items() for y in ys} | {(x, y) for x in q for y in q if x != y and near(x, y)}
    assert len(got) == len(set(got)) and set(got) == {(x, y, counts[y]) for x, y in pairs}


def test_partitions_are_cut(spark):
    words = spark.createDataFrame([(w, n) for w, n in vocabulary(9).items() if len(w) < 100], "word string, n bigint")
    sizes = spelling.partitions(words, partition_chars=60).select("a", "b", F.size("words").alias("n")).collect()
    assert all(r.n * (r.b - r.a) <= 60 or r.b - r.a <= 1 for r in sizes) and any(r.b - r.a == 1 for r in sizes)


def test_roots(spark):
    chain = [(f"w{i:04}", f"w{i + 1:04}") for i in range(100)] + [(f"v{i}", "w0050") for i in range(50)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w0100" for w, _ in chain}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).collect() == []


TEXTS = [
    (20, "Colour COLOUR colour color colors " * 4), (21, "naïve naive naives Naïve naïve naïves " * 3), (22, "ÀÉÎõü àéîõü ×÷×÷× straße strasse " * 3), (23, "abcde abcdf abcdg " * 3 + "abcde " * 9),
    (24, "theree there threre therefore therefor " * 5), (24, "there there"), (25, "a1bcdefg_hijkl.mnopq\nabcde"),
]


@pytest.mark.parametrize("rule, edit", [(None, lambda doc, word: word), (queries.dropped_letters, contract)])
def test_report(spark, rule, edit):
    pairs = cases.TEXTS + TEXTS + [(k, " ".join(f"word{chr(97 + k % 26)}ly" for _ in range(3))) for k in range(100, 600)]
    docs = cases.frame(spark, [(i, t, *[None] * (cases.WIDTH - 2)) for i, t in pairs])
    got = spelling.report(docs, rule=rule)
    assert sorted(map(tuple, got.collect())) == expected(pairs, edit)
    assert spelling.report(docs.limit(0), rule=rule).collect() == []


def test_tasks_that_count_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TASK_WORDS", 3)
    assert sorted(map(tuple, spelling.report(cases.texts(spark, TEXTS)).collect())) == expected(TEXTS)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(map(tuple, entry.queries()["op11_spelling"](spark, folder).collect()))
    assert got == expected(texts, contract)
