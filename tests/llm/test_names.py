"""Columns of any name, and plans in which frequent keys can be split."""

from __future__ import annotations

import pytest

from lakeproof.llm import decontaminate, lines, secrets, simhash, substrings

NAMES = ["doc.id", "the text.", "a`b", "c0", "th"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"some words that stand here {i} and more of them\nline\npassword: abcdef{i}", "x", i, "t") for i in range(20)] + [(None, None, None, None, None)]
    return spark.createDataFrame(rows, "a bigint, b string, c string, d int, e string").toDF(*NAMES)


def test_odd_names(spark, docs):
    items = spark.createDataFrame([("i", "an item that no document has")], "`item.id` string, `its.text` string")
    found = [
        simhash.deduplicate(docs, "doc.id", "the text."),
        lines.deduplicate(docs, "doc.id", "the text."),
        substrings.deduplicate(docs, "doc.id", "the text."),
        secrets.redact(docs, "the text."),
        decontaminate.decontaminate(docs, items, "doc.id", "the text.", "item.id", "its.text"),
        decontaminate.decontaminate(docs, items, "doc.id", "the text.", "item.id", "its.text", slice_chars=10),
    ]
    for frame in found:
        assert frame.columns == NAMES and frame.dtypes == docs.dtypes
        assert {r[0] for r in frame.collect()} <= {None, *range(20)}
    assert len(found[1].collect()) == len(found[3].collect()) == 21
    assert all("[secret]" in r[1] for r in found[3].collect() if r[1])


def final_plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_limits(spark):
    wanted = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_frequent_windows_are_split(spark, small_limits):
    docs = spark.createDataFrame([(i, f"one line\nthe next line\nand a third\n{i}\n{i}x\n{i}y") for i in range(3000)], "doc_id bigint, text string").repartition(8)
    plan = final_plan(lines.later_windows(lines.identified(docs, "doc_id", "text")))
    assert "skew=true" in plan


def test_large_components_are_split(spark, small_limits, monkeypatch):
    links = []
    monkeypatch.setattr(simhash, "connected_components", lambda found: links.append(found) or spark.range(4000).selectExpr("0L AS component", "id AS member").union(spark.range(5000, 5200).selectExpr("id AS component", "id AS member")).repartition(8))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "doc_id bigint, text string")
    written = []
    real = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, **kw: written.append(df) or real(df, **kw))
    simhash.report(docs)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in written]
    assert any("component" in df.columns and "least" in df.columns and len(df.columns) == 2 for df in written), plans
