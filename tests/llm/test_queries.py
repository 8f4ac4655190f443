"""The registered queries beside SQL, and the pipeline stage by stage, on the smallest test tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lakeproof.llm import decontaminate, queries, secrets, substrings
from lakeproof.llm.common import ready
from tests.llm.test_secrets import plain
from tests.llm.test_simhash import components
from tools.check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
ORACLES = queries.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    yield connection
    connection.close()


@pytest.fixture(scope="module")
def texts(db):
    return db.sql("SELECT doc_id, text FROM documents").fetchall()


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, db, name):
    got = canonical(entry.queries()[name](spark, FOLDER).toPandas())
    want = canonical(db.sql(ORACLES[name]).df())
    assert got == want


def test_simhash_query(spark, texts):
    got = entry.queries()["op4_simhash"](spark, FOLDER).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == components(texts)


def test_secrets_query(spark, texts):
    got = {r.doc_id: r.spans for r in entry.queries()["op6_secrets"](spark, FOLDER).collect()}
    assert set(got) == {i for i, _ in texts}
    for i, text in texts:
        assert [s for s in secrets.spans_of((text or "").encode()) if s[0] != "entropy"] == plain(text)


def test_substrings_query(spark, texts):
    got = {r[0]: tuple(r)[1:] for r in entry.queries()["op9_substrings"](spark, FOLDER).collect()}
    assert got == substrings.brute_force(texts)


def test_stages(spark):
    ready(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda frame: {r.doc_id: tuple(r) for r in frame.collect()}
    source = rows(docs)

    clean = rows(stages["toxicity"](spark, docs, FOLDER))
    assert set(clean.items()) <= set(source.items())
    assert sum(i not in clean for i, toxic in labels.items() if not toxic) <= 1  # 58 training rows are few

    single = rows(stages["exact_dedup"](spark, docs, FOLDER))
    last = {text: i for i, (_, text, *_) in sorted(source.items())}
    assert single == {i: source[i] for i in last.values()}

    apart = rows(stages["near_dedup"](spark, docs, FOLDER))
    assert apart == {i: source[i] for i, _, c in components([(i, t[1]) for i, t in source.items()]) if i == c}

    free = rows(stages["decontaminate"](spark, docs, FOLDER))
    want = {}
    for i, row in source.items():
        n, hit, _, _ = decontaminate.brute_force(row[1], items)
        if not (hit and 20 * hit >= n):
            want[i] = row
    assert free == want

    packed = stages["packing"](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in packed} == set(source)
    sizes = {r.doc_id: r.doc_tokens for r in packed}
    assert sum(r.length for r in packed) == sum(sizes.values())


def test_run_applies_all_stages(spark):
    got = {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert got == {r.doc_id for r in docs.collect()}
