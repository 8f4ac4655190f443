from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from lakeproof.llm import simhash
from tests.llm import cases


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs):
    fps = [(i, plain_fingerprint(t)) for i, t in pairs]
    label = {k: k for k in range(len(fps))}
    for a, b in combinations(range(len(fps)), 2):
        if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
            old, new = label[b], label[a]
            label = {k: new if v == old else v for k, v in label.items()}
    ids = lambda k: [i for j, (i, _) in enumerate(fps) if label[j] == label[k] and i is not None]
    return sorted(((i, f"{fp:016x}", min(ids(k), default=None)) for k, (i, fp) in enumerate(fps)), key=str)


def test_golay_code_is_perfect():
    _, error, near = simhash.golay()
    assert len(set(error.tolist())) == 1 << 11  # every syndrome has one error of weight three or less
    assert sorted({int((row >= 0).sum()) for row in near}) == [1, 6]


def test_words_at_distance_one_share_a_codeword():
    words = np.random.default_rng(1).integers(0, 1 << 23, 3000)
    nearest, near = simhash.near_codewords(words)
    assert (near[:, 0] == nearest).all()
    for bit in range(23):
        other, _ = simhash.near_codewords(words ^ (1 << bit))
        assert (near == other[:, None]).any(axis=1).all()


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_every_link_has_a_common_key(bits):
    rng = random.Random(bits)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), bits):
            b ^= 1 << bit
        key, row = simhash.keys(np.array([a, b], dtype=np.uint64))
        stored, looked = set(key[(row == 1) & (key & 1 == 0)] >> 1), set(key[(row == 0) & (key & 1 == 1)] >> 1)
        assert stored & looked


def test_fingerprint():
    for _, text in cases.TEXTS:
        if text != cases.LONG:
            assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)
    assert simhash.fingerprint(cases.LONG.encode()) == plain_fingerprint(cases.LONG)


def near_copies(n, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    out = []
    for _ in range(n):
        words = list(base)
        words[rng.randrange(300)] = f"v{rng.randint(0, 9)}"
        out.append(" ".join(words))
    return out


def test_report_is_brute_force(spark):
    pairs = [p for p in cases.TEXTS if p[1] != cases.LONG] + list(enumerate(near_copies(150), 100))
    got = simhash.report(cases.texts(spark, pairs)).collect()
    assert sorted(map(tuple, got), key=str) == components(pairs)


def test_large_buckets_are_spanned():
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = []
    for _ in range(400):
        x = base
        for bit in rng.sample(range(64), 2):
            x ^= 1 << bit
        fps.append(x)
    links = simhash.spanning_links(np.array(fps, dtype=np.uint64))
    assert len(links) == len(set(fps)) - 1 and all((a ^ b).bit_count() <= 3 for a, b in links)
    assert simhash.spanning_links(np.array([0, (1 << 64) - 1, 1], dtype=np.uint64)) == [(0, 1)]
    key = np.array([8] * 400 + [9] * 400)
    left, right = simhash._bucket_links(key, np.array(fps * 2, dtype=np.uint64))
    assert len(left) == len(set(fps)) - 1 and (np.bitwise_count(left ^ right) <= 3).all()


def test_deduplicate(spark):
    docs = cases.frame(spark)
    got = simhash.deduplicate(docs)
    assert got.schema.names == docs.schema.names
    groups = components(cases.TEXTS)
    kept = sorted((i for i, _, c in groups if i is None or i == c), key=str)
    assert sorted((r.doc_id for r in got.collect()), key=str) == kept
    assert simhash.deduplicate(cases.frame(spark, [])).collect() == []
    assert simhash.report(cases.frame(spark, [])).collect() == []


def test_texts_under_one_id_are_judged_apart(spark):
    first, copy = next((a, b) for a, b in combinations(near_copies(20), 2) if 0 < (plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count() <= 3)
    clean = "a text without any copy under the id of one"
    docs = cases.texts(spark, [(1, first), (2, copy), (2, clean), (3, copy), (None, copy)])
    got = simhash.deduplicate(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, first), (2, clean), (None, copy)], key=str)
    narrow = docs.select(docs.doc_id.cast("int").alias("doc_id"), "text")
    assert sorted(map(tuple, simhash.deduplicate(narrow).collect()), key=str) == sorted(map(tuple, got), key=str)
