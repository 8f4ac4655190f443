"""Rules against Python's own matcher, which has the semantics the rules were written for."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lakeproof.operators import text_rules as tr
from lakeproof.plans.corpus import STATEMENTS
from lakeproof.rulesets import code
from lakeproof.rulesets.lake_sql import LAKE_SQL_RULES, Rule

TEXTS = [s.replace("{k}", "7").replace("{n}", "42") for s in STATEMENTS] + [
    "",
    "plain prose without any call",
    "select date_add('day', -3, d), DATE_ADD('month', 2, d) from t",
    "SELECT TRY(CAST(x AS INTEGER)), NVL(YEAR(d), 0), CAST(CAST(a AS VARCHAR) AS DOUBLE)",
    "éYEAR(x) YEAR(é) préYEAR (x) myYEAR(x) YEAR_(x)",
    "a||b || c|||d",
    "VALUES (1, 2), (3, 4)\nVALUES   (5)",
    "$1 costs \\1 and REPLACE(a, '$', '\\\\') || JSON_ARRAY_LENGTH(j)",
    "current_timestamp\nCURRENT_TIMESTAMP ()  CURRENT_TIMESTAMPS Current_Timestamp",
    "MAP_ENTRIES(YEAR)(d) MAP_FROM_ENTRIES(WEEK)(d)",
    "fıLTER(a, x -> x) ARRAY_DİSTINCT(a) CBſRT(x) aPPROX_DISTINCT(x)",
    "INTERVAL '5' day x[3] y_1[12] z[a] INTERVAL  '6' MONTH",
    "UNNEST(a) WITH  ORDINALITY CROSS JOIN\tUNNEST(b) AS t(c)",
    "line one YEAR(\n x\n) line three",
]


def python_apply(text, rules=LAKE_SQL_RULES):
    applied = []
    for r in rules:
        new = re.sub(r.pattern, r.replacement, text, flags=re.IGNORECASE)
        if new != text:
            applied.append(r.name)
            text = new
    return text, applied


def corpus(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "path INT, content STRING")


def test_rules_are_complete():
    assert len(LAKE_SQL_RULES) == 130 == len({r.name for r in LAKE_SQL_RULES})
    assert len({r.category for r in LAKE_SQL_RULES}) == 24


def test_apply_rules(spark):
    got = {r["path"]: (r["rewritten"], r["applied"]) for r in tr.apply_rules(corpus(spark), "content").collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == python_apply(text), text


def test_match_rules(spark):
    got = {r["path"]: r["matched"] for r in tr.match_rules(corpus(spark), "content").collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == [r.name for r in LAKE_SQL_RULES if re.search(r.pattern, text, re.IGNORECASE)], text


def test_shadowed_rules_never_apply_but_all_others_do(spark):
    applied = {n for text in TEXTS for n in python_apply(text)[1]}
    hit = {r["name"] for r in tr.rule_coverage(corpus(spark), "content").filter("files > 0").collect()}
    assert {"transform_nested", "date_sub", "try_function_cast"}.isdisjoint(applied)
    assert len(hit) >= 128


@pytest.mark.parametrize("chunk", [1, 3, 20])
def test_chunks_do_not_change_the_result(spark, chunk):
    rows = corpus(spark).select("path", tr.rewrite("content", tr.rule_steps(LAKE_SQL_RULES[:40]), chunk).alias("r")).collect()
    for r in rows:
        assert (r["r"]["text"], r["r"]["applied"]) == python_apply(TEXTS[r["path"]], LAKE_SQL_RULES[:40])


def test_chunks_are_bounded():
    with pytest.raises(ValueError, match="chunk"):
        tr.rewrite("content", tr.rule_steps(LAKE_SQL_RULES), 200)


def test_own_rules(spark):
    rules = [Rule("one", "X", r"\bFOO\(\s*(\w+)\)", r"BAR(\1, '$')"), Rule("two", "X", r"\bBAR\(", r"BAZ("), Rule("three", "X", r"z+", r"Z")]
    got = tr.apply_rules(corpus(spark, ["foo( a) zz", "nothing"]), "content", rules).orderBy("path").collect()
    assert [(r["rewritten"], r["applied"]) for r in got] == [("BAZ(a, '$') Z", ["one", "two", "three"]), ("nothing", [])]
    unused = tr.unused_rules(corpus(spark, ["foo(a)"]), "content", rules)
    assert [r["name"] for r in unused.orderBy("ord").collect()] == ["two", "three"]


def test_replacements():
    assert tr.spark_replacement(r"A(\1, '$', \2)") == r"A($1, '\$', $2)"


def test_summary_and_completion(spark):
    files = spark.createDataFrame(
        [("b1", "translated", ["x", "y"]), ("b1", "failed", ["x"]), ("b2", "pending", []), ("b2", "translated", ["z"]), ("b3", None, [])],
        "batch_id STRING, status STRING, applied ARRAY<STRING>",
    )
    rules = [Rule(n, "X", n, n) for n in "zyx"]
    total = tr.translation_summary(files.filter("batch_id = 'b1'"), rules=rules).first()
    assert (total["total_files"], total["succeeded"], total["failed"], total["patterns_applied"]) == (2, 1, 1, ["x", "y"])
    done = {r["batch_id"]: (r["completion"], r["batch_status"]) for r in tr.batch_completion(files).collect()}
    assert done == {"b1": (100.0, "completed"), "b2": (50.0, "pending"), "b3": (100.0, "completed")}


def test_query_validation(spark):
    paths = spark.createDataFrame([("a", None), ("b", "no such column"), ("c", None)], "path STRING, error STRING")
    texts = spark.createDataFrame([("a", "SELECT é"), ("b", "SELECT 1")], "path STRING, content STRING")
    outcomes = tr.query_outcomes(paths, texts, "path", "content")
    assert tr.query_validation_report(outcomes).first().asDict() == {"total_queries": 3, "passed": 2, "failed": 1, "total_bytes_scanned": 90}
    assert [tuple(r) for r in tr.query_validation_failures(outcomes, "path").collect()] == [("b", "no such column")]


SOURCES = {
    "one path": "x = 's3://b/a-b.c/d_e'",
    "several": 's3://a/b s3://c and s3://a/b\ns3://é/x',
    "operators": "AthenaOperator(AwsAthenaOperator) MyAthenaOperator AthenaOperator2",
    "map": "schema MapType of a Map here\nStructField only\nmap of MAPTYPE and map",
    "separate lines": "MapType\nmap",
    "client": "boto3.client('athena') boto3.client( \"athena\" ) boto3.client('s3')",
    "nothing": "SELECT 1",
    "empty": "",
}


def test_dependencies(spark):
    rows = spark.createDataFrame(list(SOURCES.items()), "path STRING, content STRING")
    want = []
    for path, text in SOURCES.items():
        for _kind, job_type, pattern, flags in code.DEPENDENCY_PATTERNS:
            found = re.findall(pattern, text, re.IGNORECASE if flags else 0)
            if found:
                want.append((path, job_type, found))
    hits = tr.scan_dependencies(rows, "content")
    assert sorted((r["path"], r["job_type"], r["references"]) for r in hits.collect()) == sorted(want)
    report = {r["job_type"]: (r["jobs"], r["total_references"]) for r in tr.dependency_report(hits).collect()}
    assert report["LAMBDA"] == (1, 2) and report["AIRFLOW_DAG"] == (1, 2)
    status = {r["path"]: r["status"] for r in tr.has_athena_reference(rows, "content").collect()}
    assert {p for p, s in status.items() if s == "needs_rewrite"} == {"operators", "client"}


@pytest.mark.parametrize(
    "body, category",
    [
        ("import os\nfunction f() {}", "CLOUD_RUN_REMOTE"),
        ("return 'http://x'", "CLOUD_RUN_REMOTE"),
        ("require ('fs')", "CLOUD_RUN_REMOTE"),
        ("const a = 1", "JS_UDF"),
        ("x => x", "JS_UDF"),
        ("CREATE FUNCTION f(a) RETURN a + 1", "SQL_UDF"),
        ("CLASS Import VAR", "SQL_UDF"),
        ("reimport declassé élet lets", "SQL_UDF"),
        ("", "SQL_UDF"),
    ],
)
def test_code_classes(spark, body, category):
    frame = tr.classify_code(spark.createDataFrame([("f", body)], "name STRING, body STRING"), "body")
    assert frame.first()["category"] == category
    report = tr.classify_code_report(frame).first().asDict()
    assert report["total"] == 1 and report[category.lower()] == 1


def test_workflow_files(spark):
    texts = [
        "from airflow.providers.amazon.aws.operators.athena import AthenaOperator\nAthenaOperator(out='s3://a')",
        "airflow.providers.amazon.aws.operators.emr_add_steps EmrAddStepsOperator XEmrAddStepsOperator",
        "airflow.providers.amazon.aws.sensors.s3_key.S3KeySensor",
        "print('nothing')",
    ]
    rows = tr.rewrite_workflow_files(corpus(spark, texts), "content")
    got = {r["path"]: (r["rewritten"], r["changes"]) for r in rows.collect()}
    assert got[0][0] == "from airflow.providers.google.cloud.operators.bigquery import BigQueryInsertJobOperator\nBigQueryInsertJobOperator(out='gs://a')"
    assert [c.split(":")[0] for c in got[0][1]] == ["Import", "Operator", "Storage path"]
    # the short module path is not replaced inside the long one
    assert got[1][0] == "airflow.providers.google.cloud.operators.dataproc DataprocSubmitJobOperator XEmrAddStepsOperator"
    assert got[2][0] == "airflow.providers.google.cloud.sensors.gcs.GCSObjectExistenceSensor"
    assert got[3] == ("print('nothing')", [])
    assert tr.rewrite_report(rows).first().asDict() == {"processed": 4, "rewritten": 3, "changes": 7}
    assert tr.rewrite_changes(rows, "path").count() == 7


def test_wrapped_columns(spark):
    texts = ["region = 'x' AND UPPER(region) = y", "Region, region2, my_region, region", "none"]
    got = {r["path"]: (r["wrapped"], r["columns_normalised"]) for r in tr.wrap_columns(corpus(spark, texts), "content", ["region", "y"]).collect()}
    assert got[0] == ("UPPER(region) = 'x' AND UPPER(region) = UPPER(y)", 2)
    assert got[1] == ("UPPER(Region), region2, my_region, UPPER(region)", 2)
    assert got[2] == ("none", 0)


def test_rules_of_any_form_are_tried(spark):
    long_name = "F" + "O" * 44
    rules = [
        Rule("long", "X", rf"\b{long_name}\(", "G("),
        Rule("either", "X", r"\bFOO\(|\bBAR\(", "BAZ("),
        Rule("maybe", "X", r"\bQUX\(?z", "y"),
        Rule("interval_quoted", "X", r"\bSINCE\b", "from"),
    ]
    texts = [f"SELECT {long_name}(1)", "SELECT BAR(1)", "SELECT quxz", "x SINCE y", "FOO (1)"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: r["matched"] for r in tr.match_rules(frame, "t", rules).collect()}
    assert got == {0: ["long"], 1: ["either"], 2: ["maybe"], 3: ["interval_quoted"], 4: []}


def test_coverage_tries_the_rules_once_per_text(spark):
    plan = tr.rule_coverage(corpus(spark).repartition(2), "content", LAKE_SQL_RULES[:3])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan and "size(transform(" not in plan
