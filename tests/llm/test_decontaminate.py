from __future__ import annotations

import random
import tracemalloc
import weakref

from lakeproof.llm import decontaminate
from tests.llm import cases


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def sample(seed=3):
    rng = random.Random(seed)
    vocabulary = "alpha beta Gamma delta é epsilon 7 zeta".split()
    text = lambda n: rng.choice([" ", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([2, 3, 13, 15, 20]))) for i in range(12)] + [(90, None), (91, ""), (11, "short item"), (92, "!?")]
    docs = [(i, text(rng.randint(0, 60)) + " " + rng.choice(items[:12])[1] * rng.randint(0, 1) + " " + text(5)) for i in range(80)]
    return items, docs + [(1000 + k, t) for k, (_, t) in enumerate(cases.TEXTS) if t != cases.LONG]


def want(items, docs):
    named = [(str(i), t) for i, t in items]
    out = {}
    for i, t in docs:
        n, hit, owners, digest = decontaminate.brute_force(t, named)
        out[i] = (n, hit, len(owners), digest, hit > 0 and 20 * hit >= n)
    return out


def test_report_is_brute_force(spark):
    items, docs = sample()
    got = decontaminate.report(cases.texts(spark, docs), benchmark(spark, items)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want(items, docs)


def test_a_large_benchmark_is_scanned_in_slices(spark):
    items, docs = sample(4)
    docs += docs[:5]  # repeated rows
    got = decontaminate.report(cases.texts(spark, docs), benchmark(spark, items), slice_chars=150).collect()
    assert len(got) == len(docs)
    assert {r[0]: tuple(r)[1:] for r in got} == want(items, docs)
    one = decontaminate.decontaminate(cases.texts(spark, docs), benchmark(spark, items)).collect()
    many = decontaminate.decontaminate(cases.texts(spark, docs), benchmark(spark, items), slice_chars=150).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    assert {r.doc_id for r in one} == {i for i, v in want(items, docs).items() if not v[4]}


def test_one_slice_is_held_at_a_time(spark, monkeypatch):
    items, docs = sample(5)
    rng = random.Random(6)
    long = " ".join(rng.choice("alpha beta gamma delta eta theta iota kappa".split()) for _ in range(400))
    items.append((70, long))
    docs += [(500, long[700:900]), (501, long), (502, "x " + long[:300] + " y")]
    built, sizes, init = [], [], decontaminate.Windows.__init__

    def build(self, rows):
        assert not any(ref() for ref in built)
        built.append(weakref.ref(self))
        sizes.append(sum(len(text) for _, text in rows))
        init(self, rows)

    monkeypatch.setattr(decontaminate.Windows, "__init__", build)
    got = decontaminate.report(cases.texts(spark, docs), benchmark(spark, items), slice_chars=800).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want(items, docs)
    assert len(built) > 4 and max(sizes) < len(long) / 1.5


def test_pieces_have_the_windows_of_the_text():
    rng = random.Random(7)
    for _ in range(200):
        words = [b"w%d" % rng.randint(0, 50) for _ in range(rng.randint(0, 120))]
        text, limit = b", ".join(words), rng.randint(1, 300)
        grams = lambda w: {tuple(w[i : i + 13]) for i in range(max(len(w) - 12, 1))} - {()}
        cut = list(decontaminate.pieces(text, limit))
        assert set().union(*(grams(decontaminate.words_of(p)) for p in cut)) == grams(words)
        assert sum(len(decontaminate.words_of(p)) for p in cut) <= 2 * len(words) + 13


def test_spans_are_removed(spark):
    words = " ".join(f"w{i}" for i in range(13))
    docs = cases.texts(spark, [(1, f"Before, {words.upper()}! after."), (2, f"{words} {words}"), (3, "clean"), (4, None)])
    got = decontaminate.decontaminate(docs, benchmark(spark, [(1, words)]), remove="spans").collect()
    assert {r.doc_id: r.text for r in got} == {1: "Before, ! after.", 2: "", 3: "clean", 4: None}


def test_edge_cases(spark):
    docs = cases.frame(spark)
    items = benchmark(spark, [(1, "quick brown fox"), (1, "fox jumps"), (None, "one two")])
    got = decontaminate.decontaminate(docs, items)
    assert got.schema.names == docs.schema.names
    assert got.filter("doc_id in (0, 1)").count() == 0
    rows = decontaminate.report(docs, items).filter("doc_id = 7").select("n_hit", "n_items").collect()
    assert sorted(map(tuple, rows)) == [(0, 0), (2, 0), (2, 0)]
    empty = benchmark(spark, [])
    assert decontaminate.decontaminate(docs, empty).count() == len(cases.TEXTS)
    assert decontaminate.report(cases.frame(spark, []), items).collect() == []


def test_memory_of_a_slice():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(30_000)]
    items = [(f"i{k}", " ".join(rnd.choice(words) for _ in range(200)).encode()) for k in range(2_000)]
    chars = sum(len(t) for _, t in items)
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    windows = decontaminate.Windows(items)
    used = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert used <= 20 * chars and windows.hits(decontaminate.words_of(items[7][1]))[1] == {"i7"}


def test_windows_that_many_items_share():
    shared = b" ".join(b"w%d" % k for k in range(20))
    items = [(f"i{k}", shared + b" tail%d" % k) for k in range(50)] + [("short", b"w1 w2"), (None, b"w1 w2"), ("same", b"w1 w2")]
    windows = decontaminate.Windows(items)
    assert windows.hits(decontaminate.words_of(shared)) == ([(0, 20)], {f"i{k}" for k in range(50)} | {"short", "same", None})
    assert windows.hits([b"w1"]) == ([], set()) and windows.hits([b"w1", b"w2"]) == ([(0, 2)], {"short", "same", None})
    assert decontaminate.Windows([]).hits([b"a"]) == ([], set()) and decontaminate.Windows([("e", b"")]).hits([b"a"]) == ([], set())
