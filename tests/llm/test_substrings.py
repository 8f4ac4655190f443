from __future__ import annotations

import random

import numpy as np
import pytest

from lakeproof.llm import substrings
from lakeproof.llm.suffix_array import ranks, suffix_array
from tests.llm import cases


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for _ in range(200):
        text = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
        assert suffix_array(np.array(text, dtype=np.int64)) == sorted(range(len(text)), key=lambda i: text[i:])


def test_ranks():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    rank, common = ranks(strings, 30)
    padded = sorted({s.ljust(32, b"\0") for s in strings})
    assert [padded[r] for r in rank] == [s.ljust(32, b"\0") for s in strings]
    for k in range(1, len(padded)):
        a, b = padded[k - 1], padded[k]
        assert common[k] == next(i for i in range(32) if a[i] != b[i])


def test_segments_cover_every_string_once():
    rng = random.Random(4)
    for text in (bytes(rng.choice(b"abc ") for _ in range(3000)), b"x" * 500, b"ab" * 300, b"y" * 100, b"z" * 99):
        starts = [p for _, first, n, left in substrings.segments(text) for f, k in zip(first, n, strict=True) for p in range(f, f + k)]
        assert starts == list(range(len(text) - 99))
        for _, first, n, left in substrings.segments(text):
            assert ((left - n + 1 >= 0) & (left <= 84)).all()


def planted(seed=7):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([90, 99, 100, 101, 140, 300]))) for _ in range(12)]
    noise = lambda: "".join(rng.choice("ijklmnop ü") for _ in range(rng.randint(0, 150)))
    docs = [(i, noise() + "".join(rng.choice(passages) + noise() for _ in range(rng.randint(0, 4)))) for i in range(60)]
    return docs + [(100, "q" * 1000), (101, "rs" * 400), (102, "q" * 300), (103, None), (104, ""), (-5, docs[3][1])]


@pytest.mark.parametrize("hot", [50_000, 2])
def test_report_is_brute_force(spark, hot):
    docs = planted()
    got = substrings.report(cases.texts(spark, docs), hot_anchor=hot).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == substrings.brute_force(docs)


def test_long_texts_are_scanned_in_steps(spark, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(substrings.STEP + 5000))
    docs = [(1, text), (2, text[-3000:] + "!" + text[substrings.STEP - 400 : substrings.STEP + 400])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in substrings.report(cases.texts(spark, docs)).collect()}
    assert got == {1: (0, 0), 2: (3800, 2)}


def test_edge_cases(spark):
    docs = cases.frame(spark)
    got = substrings.deduplicate(docs)
    assert got.schema.names == docs.schema.names and got.count() == len(cases.TEXTS)
    assert substrings.report(docs).count() == len(cases.TEXTS)
    assert substrings.deduplicate(cases.frame(spark, [])).collect() == []
    # a row that is listed twice is not a copy of itself; another row with its text is
    text = "0123456789" * 12
    rows = cases.texts(spark, [(1, "a " + text[:110]), (1, "a " + text[:110]), (2, "b " + text[:110]), (None, "c " + text[:110])])
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.report(rows).collect())
    want = substrings.brute_force([(0, "c " + text[:110]), (1, "a " + text[:110]), (2, "b " + text[:110])])
    assert got == [(0, want[0][1]), (1, want[1][1]), (1, want[1][1]), (2, want[2][1])]


def test_cut_texts(spark):
    text = "é" * 60 + "x"
    got = substrings.deduplicate(cases.texts(spark, [(1, text), (2, "a" + text)])).collect()
    assert {r.doc_id: r.text for r in got}[2] == "a"
