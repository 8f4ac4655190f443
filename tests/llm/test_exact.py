from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lakeproof.llm import exact
from tests.llm import cases


def expected(pairs, keep):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    out = []
    for i, t in pairs:
        ids = [x for x in groups[t or ""] if x is not None]
        best = {"min": min, "max": max}[keep](ids) if ids else None
        out.append((i, best, len(groups[t or ""]), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_report(spark, keep):
    got = exact.report(cases.frame(spark), keep=keep).collect()
    assert sorted(map(tuple, got), key=str) == expected(cases.TEXTS, keep)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_deduplicate_keeps_one_row_of_each_text(spark, keep):
    docs = cases.frame(spark)
    got = exact.deduplicate(docs, keep=keep)
    assert got.schema.names == docs.schema.names
    rows = got.collect()
    best = {sha: keep_id for _, keep_id, _, _, sha in expected(cases.TEXTS, keep)}
    assert {hashlib.sha256((r["text"] or "").encode()).hexdigest(): r["doc_id"] for r in rows} == best
    assert len(rows) == len(best)


def test_columns_that_cannot_be_ordered(spark):
    docs = cases.frame(spark).withColumn("m", F.create_map(F.lit("a"), F.col("doc_id")))
    assert exact.deduplicate(docs).count() == len({t or "" for _, t in cases.TEXTS})


def test_null_text_stays_null(spark):
    docs = cases.texts(spark, [(1, None), (2, None), (3, "x")])
    assert {(r.doc_id, r.text) for r in exact.deduplicate(docs).collect()} == {(1, None), (3, "x")}


def test_colliding_hashes_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact, "content_hash", lambda text: F.unhex(F.lit("00")))
    pairs = [(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "b")]
    got = exact.report(cases.texts(spark, pairs)).collect()
    assert sorted(map(tuple, got), key=str) == expected(pairs, "min")
    assert sorted(r.doc_id for r in exact.deduplicate(cases.texts(spark, pairs)).collect()) == [1, 3, 4]


def test_empty(spark):
    assert exact.report(cases.frame(spark, [])).collect() == []
    assert exact.deduplicate(cases.frame(spark, [])).collect() == []
