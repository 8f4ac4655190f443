from __future__ import annotations

import os
import zlib

import pytest
from pyspark.sql import functions as F

from lakeproof.llm import toxicity
from tests.llm import cases

FOLDER = "/root/testdata/sf0.1"


def auc(rows):
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@pytest.fixture(scope="module")
def tables(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    scores = toxicity.report(docs, labels)
    rows = scores.join(labels, "doc_id").filter("held_out").select("score", "toxic", "predicted").collect()
    assert auc([(r.score, r.toxic) for r in rows]) > 0.98
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert scores.count() == docs.count()


def test_held_out_labels_are_not_used(tables):
    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    once = {r.doc_id: (r.held_out, round(r.score, 9)) for r in toxicity.report(docs, labels).collect()}
    again = {r.doc_id: (r.held_out, round(r.score, 9)) for r in toxicity.report(docs, turned).collect()}
    assert once == again
    assert {i: h for i, (h, _) in once.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in once}


def test_features():
    learned = {b"blorp": 4.0, b"zarg*": 5.0}
    by = lambda text: dict(zip(toxicity.FEATURES, toxicity.features(text.encode(), learned), strict=True))
    got = by("You are a STUPID zargish blorp !!")
    assert got["insult_count"] == 1 and got["learned_count"] == 3 and got["strongest"] == 5.0
    assert got["near_second_person"] == 3 / 6 and got["exclamation"] > 0 and got["shouted_words"] == 1 / 6
    assert by("such an 1d10t")["unmasked_hits"] == 1
    assert by("s t u p i d")["spaced_letters"] == 1
    assert toxicity.features(None, learned) == toxicity.features(b"", learned)
    assert len(toxicity.features(b"", learned)) == len(toxicity.FEATURES)


def test_edge_cases(spark, tables):
    docs = cases.frame(spark)
    labels = tables[1]
    got = toxicity.report(docs, labels)
    assert got.count() == len(cases.TEXTS)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.report(docs, none).collect()} == {0.0}
    odd = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (2, 7)], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.report(docs, odd).collect()} == {0.0}
    kept = toxicity.reject(docs, none)
    assert kept.schema.names == docs.schema.names and kept.count() == len(cases.TEXTS)
    assert toxicity.report(cases.frame(spark, []), labels).collect() == []


def test_reject_keeps_columns_and_clean_documents(spark, tables):
    docs, labels = tables
    more = docs.withColumn("features", F.lit("x")).withColumn("prediction", F.lit(1)).withColumn("probability", F.lit(2))
    kept = toxicity.reject(more, labels)
    assert kept.columns == more.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    known = [truth[i] for i in gone if i in truth]
    assert known and sum(known) / len(known) > 0.95
