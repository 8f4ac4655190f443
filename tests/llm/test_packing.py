from __future__ import annotations

import zlib
from collections import Counter, deque

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakeproof.llm import packing
from tests.llm import cases


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def test_ids_are_those_of_the_tokenizer_file(tokenizer):
    encode = packing.encoder(packing.VOCABULARY)
    odd = ["", " ", "\n\n  x", "don't  we'll", "\x00\x01", "a" * 5000, "漢字 \U0001f600é", "<|endoftext|> x", " " * 300, "1234567 +-*/  　", "ſ K"]
    for text in odd + [t for _, t in cases.TEXTS if t]:
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [1_000_000, 5_000_000])
@pytest.mark.parametrize("one", ["\n", " ", "\t", "a"])
def test_long_runs(one, size, tokenizer):
    text = "some words" + one * size + "and more"
    assert packing.encoder(packing.VOCABULARY)(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_runs_are_packed(spark, tokenizer):
    texts = [(1, "\n" * 1_000_000), (2, "x" + " " * 600_000 + "y"), (3, "short")]
    rows = packing.pack(spark.createDataFrame([(i, t, "s") for i, t in texts], "doc_id bigint, text string, source string"), with_ids=True).collect()
    check(rows, texts, tokenizer, 1024)


def check(rows, pairs, tokenizer, window):
    want = Counter()
    for i, t in pairs:
        want[(i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0]))] += 1
    by_sequence, by_doc = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(ids.tolist())))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)
    got = Counter()
    for (doc, size), parts in by_doc.items():
        parts.sort()
        copies = len([1 for s, _ in parts if s == 0])
        tokens = sum(len(p) for _, p in parts)
        assert tokens == copies * size
        if copies == 1:
            got[(doc, sum((p for _, p in parts), ()))] += 1
    single = {k: v for k, v in want.items() if sum(1 for (i, ids), n in want.items() if i == k[0] and len(ids) == len(k[1]) for _ in range(n)) == 1}
    assert {k: 1 for k in single} == dict(got)
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())


@pytest.mark.parametrize("limits", [{}, {"window": 64, "grain": 8, "block_tokens": 2000, "item_tokens": 300}])
def test_every_id_is_in_one_piece(spark, tokenizer, limits):
    rows = packing.pack(cases.frame(spark), with_ids=True, **limits).collect()
    check(rows, cases.TEXTS, tokenizer, limits.get("window", 1024))


def test_windows_follow_the_targets():
    queues = {s: deque((f"{s}{i}", 700) for i in range(n)) for s, n in (("a", 100), ("b", 50), ("c", 50))}
    shares = {"a": 0.5, "b": 0.25, "c": 0.25}
    deficits = dict.fromkeys(queues, 0.0)
    got = Counter()
    windows = list(packing.deal(queues, deficits, shares, 1024, 256))
    for number, pieces in enumerate(windows, 1):
        for item, _, length in pieces:
            got[item[0]] += length
        if number < len(windows) - 2:
            assert sum(p[2] for p in pieces) == 1024
            assert all(abs(got[s] - number * 1024 * shares[s]) <= 1024 for s in shares)
    assert got == {"a": 70000, "b": 35000, "c": 35000}
    assert all(abs(d) < 1025 for d in deficits.values())


def test_deficits_are_carried_over_blocks():
    counts = pd.DataFrame({"block": [0, 0, 1, 2], "source": ["a", None, "a", None], "n": [30, 10, 20, 40], "share": [0.5, 0.5, 0.5, 0.5]})
    got = {(r.block, r.source): r.deficit for r in packing._carry(counts).itertuples()}
    assert got == {(0, "a"): 0, (0, None): 0, (1, "a"): -10, (1, None): 10, (2, "a"): -20, (2, None): 20}


def test_targets_and_limits(spark):
    docs = spark.createDataFrame([(i, "some words to pack " * 40, "ab"[i % 2]) for i in range(60)], "doc_id bigint, text string, source string")
    rows = packing.pack(docs, targets={"a": 3, "b": 1}, window=256, grain=32).collect()
    first = [r for r in rows if r.sequence_id < 20]
    share = sum(r.length for r in first if r.source == "a") / sum(r.length for r in first)
    assert abs(share - 0.75) < 0.05
    assert packing.pack(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs, window=1000)


def test_powers():
    assert packing.powers(700) == [512, 128, 32, 16, 8, 4]
