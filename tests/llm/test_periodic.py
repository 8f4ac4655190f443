from __future__ import annotations

import hashlib
import os
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from lakeproof.llm import periodic, queries
from lakeproof.llm.wavelet import Blocks, WaveletTree
from tests.llm import cases


def plain_runs(words):
    """All periods of all stretches, one by one."""
    n, found = len(words), {}
    for period in range(1, n // 4 + 1):
        i = 0
        while i + period < n:
            start = i
            while i + period < n and words[i] == words[i + period]:
                i += 1
            if i + period - start >= max(6, 4 * period):
                found.setdefault((start, i + period), period)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def expected(doc, text, rule=None):
    words = (text or "").encode().split()
    words = rule(doc, words) if rule else words
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    listed = "".join("%d,%d,%d\n" % r for r in runs)
    return (
        doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), len(words), len(kept),
    )


def repeated(seed):
    rnd = random.Random(seed)
    words = [rnd.choice("ab" if seed % 2 else "abcdef") for _ in range(rnd.randint(0, 150))]
    for _ in range(rnd.randint(0, 4)):
        if words:
            at, size = rnd.randrange(len(words)), rnd.randint(1, 20)
            words[at : at + size] = words[at : at + size] * rnd.randint(1, 9)
    return [w.encode() for w in words]


def test_runs_of_repeated_stretches():
    texts = [repeated(seed) for seed in range(600)]
    for k in range(0, len(texts), 7):
        lot = texts[k : k + 7]
        assert [sorted(r) for r in periodic.runs_of_texts(lot)] == [plain_runs(words) for words in lot]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=80).map(lambda t: [c.encode() for c in t]), max_size=4))
def test_runs_of_any_texts(lot):
    assert [sorted(r) for r in periodic.runs_of_texts(lot)] == [plain_runs(words) for words in lot]


def test_a_block_with_a_period_of_its_own():
    # blocks of the outer period are periodic themselves: several occurrences are near, and only stretch ends tell the period
    inner = [b"a", b"b"] * 9 + [b"a"]
    outer = (inner + [b"c"]) * 5
    assert (0, 100, 20) in periodic.runs_of_texts([outer])[0]
    assert sorted(periodic.runs_of_texts([outer])[0]) == plain_runs(outer)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60), st.data())
def test_successors(values, data):
    import numpy as np

    tree = WaveletTree(np.array(values, dtype=np.int64))
    asked = [(sorted((data.draw(st.integers(0, len(values))), data.draw(st.integers(0, len(values))))), data.draw(st.integers(0, 70))) for _ in range(5)]
    low, high, least = (np.array(c, dtype=np.int64) for c in zip(*[(a, b, x) for (a, b), x in asked], strict=True))
    want = [min((v for v in values[a:b] if v >= x), default=-1) for (a, b), x in asked]
    assert tree.successor(low, high, least).tolist() == want


def test_blocks():
    import numpy as np

    text = "abracadabraabracadabra$"
    symbols = np.array([ord(c) for c in text], dtype=np.int64)
    blocks = Blocks(symbols)
    assert blocks.order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    for k, (names, sizes) in enumerate(zip(blocks.names, blocks.sizes, strict=True)):
        for i in range(len(text) - (1 << k) + 1):
            same = {j for j in range(len(text)) if text[j : j + (1 << k)] == text[i : i + (1 << k)]}
            assert set(blocks.order[names[i] : names[i] + sizes[names[i]]].tolist()) == same
    a, b = np.array([0, 11, 2, 3]), np.array([11, 18, 9, 4])
    assert blocks.common_after(a, b).tolist() == [len(os.path.commonprefix([text[i:], text[j:]])) for i, j in zip(a, b, strict=True)]
    assert blocks.common_before(a, b).tolist() == [len(os.path.commonprefix([text[:i][::-1], text[:j][::-1]])) for i, j in zip(a, b, strict=True)]


DOCS = [(100 + k, " ".join(w.decode() for w in repeated(k))) for k in range(40)] + [
    (200, "x " * 3000), (201, "a b c\x0bd\x1ce " * 4), (202, "new\nline\n" * 3), (203, "x x x x x"), (204, "go go go go go go"),
]


@pytest.mark.parametrize("rule", [None, queries.repeated_tail])
def test_report(spark, rule):
    pairs = [p for p in cases.TEXTS if p[1] != cases.LONG] + DOCS
    docs = cases.frame(spark, [(i, t, *[None] * (cases.WIDTH - 2)) for i, t in pairs])
    got = periodic.report(docs, rule=rule).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(i, t, rule) for i, t in pairs), key=str)
    assert periodic.report(docs.limit(0), rule=rule).collect() == []


def test_long_texts_and_repeated_rows(spark):
    text = cases.LONG + " end" * 50_000
    rows = periodic.report(cases.texts(spark, [(1, text), (1, text), (2, cases.LONG)])).collect()
    assert len(rows) == 3 and rows[0][1:] == rows[1][1:]
    assert (rows[0].length, rows[0].period) == (50_000, 1)


def test_find_and_collapse(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in DOCS] + [(None, None, "n")], "`doc.id` bigint, text string, `a.b` string")
    found = {}
    for r in periodic.find(docs, id_col="doc.id").collect():
        found.setdefault(r.doc_id, []).append((r.start, r.length, r.period))
    assert {i: sorted(r) for i, r in found.items()} == {i: r for i, t in DOCS if (r := plain_runs(t.encode().split()))}
    kept = periodic.collapse(docs)
    assert kept.columns == docs.columns
    texts = {r[0]: r[1] for r in kept.collect()}
    for i, t in DOCS:
        words = t.encode().split()
        want = expected(i, t)[7]
        assert hashlib.sha256(texts[i].encode()).hexdigest() == want if plain_runs(words) else texts[i] == t
    assert texts[None] is None


def test_rule_of_the_contract():
    for doc in range(3000):
        words = [b"%d" % k for k in range(doc % 50)]
        got, h, n = queries.repeated_tail(doc, words), zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert got == words


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(map(tuple, entry.queries()["op12_periodic"](spark, folder).collect()))
    assert got == sorted(expected(i, t, queries.repeated_tail) for i, t in texts)
