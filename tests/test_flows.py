from __future__ import annotations

import json

from pyspark.sql import functions as F

from lakeproof import flows
from lakeproof.sources import writers


def test_translate_folder(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.sql").write_text("SELECT APPROX_DISTINCT(x), TRY_CAST(y AS BIGINT) FROM t")
    (source / "b.sql").write_text("SELECT 1")
    (source / "c.txt").write_text("APPROX_DISTINCT(x)")
    summary = flows.translate_folder(spark, str(source), str(tmp_path / "out")).first()
    assert (summary["total_files"], summary["succeeded"], summary["failed"]) == (2, 2, 0)
    assert summary["patterns_applied"] == ["approx_distinct", "try_cast"]
    texts = {r["path"].rsplit("/", 1)[1]: r["rewritten"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert texts == {"a.sql": "SELECT APPROX_COUNT_DISTINCT(x), SAFE_CAST(y AS BIGINT) FROM t", "b.sql": "SELECT 1"}


def test_a_file_that_is_no_text_fails_alone(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.sql").write_text("SELECT NOW() -- é")
    (source / "b.sql").write_bytes(b"SELECT \xff\xfe NOW()")
    summary = flows.translate_folder(spark, str(source), str(tmp_path / "out")).first()
    assert (summary["total_files"], summary["succeeded"], summary["failed"]) == (2, 1, 1)
    assert summary["patterns_applied"] == ["now_function"]
    rows = {r["path"].rsplit("/", 1)[1]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows["a.sql"]["rewritten"] == "SELECT CURRENT_TIMESTAMP() -- é" and rows["a.sql"]["error"] is None
    assert rows["b.sql"]["rewritten"] is None and rows["b.sql"]["status"] == "failed" and "UTF-8" in rows["b.sql"]["error"]


def test_plans_of_inventories_are_apart(spark, tmp_path):
    table = {"row_count": 1, "partitioned": False, "size_bytes": 1, "last_queried": None, "table_name": "t"}
    for name, databases in (("one", ["d1", "d2"]), ("two", ["d1"])):
        tables = [{**table, "database": d} for d in databases]
        (tmp_path / f"{name}.json").write_text(json.dumps({"inventory_id": name, "tables": tables}))
    plan = flows.plan_inventory_waves(spark, str(tmp_path), ["t"], F.lit("2025-06-01").cast("timestamp"))
    rows = sorted((r["inventory_id"], r["database"], r["table_name"], r["wave_id"], r["place"]) for r in plan.details.collect())
    assert rows == [("one", "d1", "t", "wave-1", 1), ("one", "d2", "t", "wave-1", 2), ("two", "d1", "t", "wave-1", 1)]
    assert {r["inventory_id"]: r["total_tables"] for r in plan.report.collect()} == {"one": 2, "two": 1}


def test_maps_are_found_in_schemas(spark, tmp_path):
    frame = spark.createDataFrame([(1, {"a": 1})], "k int, m map<string,int>")
    frame.write.parquet(str(tmp_path / "with_map"))
    listed = flows.list_tables(spark, "d", {"with_map": str(tmp_path / "with_map"), "without": frame.drop("m")})
    rows = {r["table_name"]: (r["row_count"], r["has_maps"], r["size_bytes"] > 0) for r in listed.collect()}
    assert rows == {"with_map": (1, True, True), "without": (1, False, False)}


def test_a_missing_table_fails_its_pair_only(spark):
    spark.range(3).createOrReplaceTempView("here")
    details = flows.validate_tables(spark, "tier1", [("here", "here"), ("here", "not_there")]).details
    assert {r["target_table"]: r["status"] for r in details.collect()} == {"here": "passed", "not_there": "failed"}


def test_inventory_to_waves(spark, tmp_path):
    day = lambda d: f"2025-05-{d:02d}T00:00:00+00:00"
    base = {"row_count": 1, "partitioned": False, "database": "d"}
    tables = [
        {**base, "table_name": "sales.b", "size_bytes": 10, "last_queried": day(30)},
        {**base, "table_name": "sales.a", "size_bytes": 2**41, "last_queried": day(30)},
        {**base, "table_name": "ops.x", "size_bytes": 10, "last_queried": None},
        {**base, "table_name": "Sales.c", "size_bytes": 10, "last_queried": day(31)},
    ]
    (tmp_path / "i.json").write_text(json.dumps({"inventory_id": "i", "tables": tables}, indent=2))
    as_of = F.lit("2025-06-01").cast("timestamp")
    counts = flows.classify_inventory(spark, str(tmp_path), as_of).report.first().asDict()
    assert counts == {"inventory_id": "i", "total_tables": 4, "tier1_count": 2, "tier2_count": 1, "tier3_count": 1}
    plan = flows.plan_inventory_waves(spark, str(tmp_path), ["sales", "ops"], as_of)
    rows = [(r["wave_id"], r["table_name"]) for r in plan.details.orderBy("wave_id", "place").collect()]
    assert rows == [("wave-1", "ops.x"), ("wave-2", "Sales.c"), ("wave-2", "sales.b"), ("wave-2", "sales.a")]
    assert {r["lob"]: r["table_count"] for r in plan.report.collect()} == {"ops": 1, "sales": 3}


def test_dependencies_and_code(spark, tmp_path):
    deps = {"r": ["a", "b"], "a": ["b"], "x": ["y"], "y": [], "alone": []}
    (tmp_path / "deps.json").write_text(json.dumps(deps))
    found = flows.analyse_dependencies(spark, str(tmp_path / "deps.json"))
    assert {(r["root"], r["dependent"], r["depth"]) for r in found.report.collect()} == {
        ("r", "a", 1), ("r", "b", 1), ("x", "y", 1), ("alone", None, 0),
    }
    assert {r["member"]: r["component"] for r in found.details.collect()} == {"r": "a", "a": "a", "b": "a", "x": "x", "y": "x", "alone": "alone"}
    (tmp_path / "code.json").write_text(json.dumps({"f": "import x", "g": "const a = 1", "h": "RETURN a"}))
    assert flows.classify_code_file(spark, str(tmp_path / "code.json")).report.first().asDict() == {
        "total": 3, "cloud_run_remote": 1, "js_udf": 1, "sql_udf": 1,
    }
    (tmp_path / "fn.json").write_text(json.dumps({"f": "boto3.client('athena')", "g": "boto3.client('s3')"}))
    assert {r["name"]: r["status"] for r in flows.check_functions(spark, str(tmp_path / "fn.json")).collect()} == {
        "f": "needs_rewrite", "g": "no_athena_references",
    }


def test_jobs_and_workflows(spark, tmp_path):
    source = tmp_path / "dags"
    source.mkdir()
    (source / "a.py").write_text("AthenaOperator(output='s3://lake/out/')")
    (source / "b.py").write_bytes(b"print('\xff')")
    jobs = flows.scan_jobs(spark, str(source), "*.py")
    assert {r["job_type"]: r["total_references"] for r in jobs.report.collect()} == {"SPARK": 1, "AIRFLOW_DAG": 1}
    (source / "b.py").write_text("print(1)")
    done = flows.rewrite_workflows(spark, str(source), str(tmp_path / "out"))
    assert done.report.first().asDict() == {"processed": 2, "rewritten": 1, "changes": 2}


def test_validation_with_event_log(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k INT, v STRING")
    table.createOrReplaceTempView("flow_source")
    table.filter("k = 1").createOrReplaceTempView("flow_short")
    log = str(tmp_path / "log")
    out = flows.validate_tables(spark, "tier1", [("flow_source", "flow_source"), ("flow_source", "flow_short")], {"flow_source": ["k"]}, log)
    assert out.report.first().asDict() == {"tier": "tier1", "tables_validated": 2, "tables_passed": 1, "tables_failed": 1}
    event = writers.read_events(spark, log).first()
    assert event["event_type"] == "ValidationCompleted" and json.loads(event["payload"])["tables_failed"] == 1


def test_queries_gates_and_policies(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.sql").write_text("SELECT 1")
    path = (tmp_path / "q" / "a.sql").as_uri()
    paths = spark.createDataFrame([(path.replace("file:///", "file:/"), None), (path, None), ("missing.sql", "no text")], "path STRING, error STRING")
    report = flows.validate_queries(spark, paths, str(tmp_path / "q")).report.first()
    assert (report["total_queries"], report["failed"], report["total_bytes_scanned"]) == (3, 1, 80)
    (tmp_path / "gate.json").write_text(json.dumps({"dvt_passed": True, "latency_ok": False}))
    gate = flows.check_gate_file(spark, str(tmp_path / "gate.json"), "wave-1").first()
    assert gate["criteria_met"] == ["dvt_passed"] and not gate["passed"]
    (tmp_path / "p.json").write_text(json.dumps([{"permission": "all", "resource": "r", "principal": "p"}]))
    assert flows.map_policies(spark, str(tmp_path / "p.json")).first()["role"] == "roles/bigquery.dataOwner"
    kpis = [{"name": "n", "legacy_value": 100, "new_value": 101, "tolerance_pct": 1.0}]
    (tmp_path / "k.json").write_text(json.dumps(kpis, indent=1))
    assert flows.reconcile_kpi_file(spark, str(tmp_path / "k.json")).first()["matched"]


def test_logs(spark, tmp_path):
    folder = tmp_path / "lake" / "t" / "_delta_log"
    folder.mkdir(parents=True)
    (folder / "0.json").write_bytes(b"x" * (9 * 1048576))
    out = flows.check_logs(spark, str(tmp_path / "lake" / "*" / "_delta_log"))
    assert out.report.first()["status"] == "CRITICAL"
    assert out.details.first()["estimated_reduction_pct"] == 60.0
