from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lakeproof import session
from lakeproof.operators import inventory as inv
from lakeproof.operators import lookups
from lakeproof.sources import readers, writers


def test_inventory_documents(spark, tmp_path):
    tables = [
        {"table_name": "a", "database": "d", "size_bytes": 5, "row_count": 1, "last_queried": "2025-01-02T03:04:05+00:00", "partitioned": True,
         "format": "DELTA", "has_maps": True},
        {"table_name": "b", "database": "d", "size_bytes": 6, "row_count": 2, "last_queried": None, "partitioned": False},
    ]
    (tmp_path / "one.json").write_text(json.dumps({"inventory_id": "one", "tables": tables, "classifications": {}}, indent=2))
    (tmp_path / "two.json").write_text(json.dumps({"inventory_id": "two", "tables": []}, indent=2))
    rows = readers.scan_inventory(spark, str(tmp_path)).orderBy("table_name").collect()
    assert [(r["inventory_id"], r["table_name"], r["format"], r["has_maps"]) for r in rows] == [("one", "a", "DELTA", True), ("one", "b", "PARQUET", False)]
    assert rows[0]["last_queried"] == datetime(2025, 1, 2, 3, 4, 5) and rows[1]["last_queried"] is None


def test_text_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.sql").write_text("SELECT 1\n-- é")
    (tmp_path / "sub" / "b.sql").write_bytes(b"ok \xff\xfe end")
    (tmp_path / "c.txt").write_text("other")
    texts = {r["path"].rsplit("/", 1)[1]: r["content"] for r in readers.scan_text_corpus(spark, str(tmp_path)).collect()}
    assert texts["a.sql"] == "SELECT 1\n-- é" and set(texts) == {"a.sql", "b.sql"}
    repaired = {r["path"].rsplit("/", 1)[1]: r["content"] for r in readers.scan_text_corpus(spark, str(tmp_path), replace_invalid=True).collect()}
    assert repaired["b.sql"] == "ok �� end" and repaired["a.sql"] == texts["a.sql"]


def test_log_listing(spark, tmp_path):
    for table, size in (("t1", 8 * 1048576), ("t2", 100)):
        folder = tmp_path / "lake" / table / "_delta_log"
        folder.mkdir(parents=True)
        (folder / "0.json").write_bytes(b"x" * size)
    files = readers.scan_file_listing(spark, str(tmp_path / "lake" / "*" / "_delta_log"))
    got = {r["table_name"]: r["status"] for r in inv.log_health(inv.log_sizes(files)).collect()}
    assert got == {"t1": "WARNING", "t2": "HEALTHY"}


def test_listing_does_not_read_contents(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    files = readers.scan_file_listing(spark, str(tmp_path))
    assert [(r["length"]) for r in files.collect()] == [3]
    assert "content" not in files.select("length")._jdf.queryExecution().executedPlan().toString()


def test_json_objects_and_records(spark, tmp_path):
    (tmp_path / "kv.json").write_text(json.dumps({"f": "x\ny", "g": "z"}, indent=1))
    assert {r["name"]: r["value"] for r in readers.scan_kv_json(spark, str(tmp_path / "kv.json")).collect()} == {"f": "x\ny", "g": "z"}
    (tmp_path / "deps.json").write_text(json.dumps({"a": ["b", "c"], "d": []}))
    deps = readers.scan_kv_json(spark, str(tmp_path / "deps.json"), "ARRAY<STRING>")
    assert {r["name"]: r["value"] for r in deps.collect()} == {"a": ["b", "c"], "d": []}
    (tmp_path / "p.json").write_text(json.dumps([{"permission": "select", "resource": "r"}, {"permission": "DROP", "principal": "p"}, {}], indent=1))
    policies = readers.scan_json_records(spark, str(tmp_path / "p.json"), "permissions")
    got = sorted(tuple(r) for r in lookups.map_permissions(policies).collect())
    assert got == [
        ("", "unknown", "unknown", "roles/bigquery.dataViewer", True),
        ("DROP", "unknown", "p", "roles/bigquery.dataViewer", True),
        ("SELECT", "r", "unknown", "roles/bigquery.dataViewer", False),
    ]


def test_reports_replace_their_ids_only(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "inventory_id STRING, n INT")
    writers.write_report(rows, path)
    writers.write_report(spark.createDataFrame([("b", 3)], "inventory_id STRING, n INT"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("inventory_id", "n").collect()) == [("a", 1), ("b", 3)]


def test_rewritten_texts_and_inventories_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("a.sql", "x", "y"), ("b.sql", "p", "q")], "path STRING, content STRING, rewritten STRING")
    writers.write_rewritten(files, str(tmp_path / "out"))
    assert {r["path"]: r["rewritten"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a.sql": "y", "b.sql": "q"}
    tables = spark.createDataFrame([("i", f"t{n}", n) for n in range(10)], "inventory_id STRING, table_name STRING, size_bytes BIGINT")
    writers.write_inventory(tables, str(tmp_path / "inv"), F.floor(F.col("size_bytes") / 4))
    back = readers.scan_inventory(spark, str(tmp_path / "inv"), multi_line=False)
    assert {(r["inventory_id"], r["table_name"], r["size_bytes"]) for r in back.collect()} == {("i", f"t{n}", n) for n in range(10)}


def test_event_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, datetime(2025, 1, 1), "x")], "id INT, at TIMESTAMP, note STRING")
    events = writers.event_rows(rows, "Checked", F.col("id"), F.col("at"), ["note"])
    writers.append_events(events, path)
    writers.append_events(writers.event_rows(rows, "Other", F.col("id"), F.col("at"), ["id", "note"]), path)
    got = {r["event_type"]: (r["aggregate_id"], r["payload"]) for r in writers.read_events(spark, path).collect()}
    assert got == {"Checked": ("1", '{"note":"x"}'), "Other": ("1", '{"id":1,"note":"x"}')}
    # the same row gives the same id
    assert events.first()["event_id"] == events.first()["event_id"]


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get(session.CHECKPOINT_CONF)
    assert session.scratch_path(spark, "x").startswith(configured)


def test_lookups(spark):
    left = spark.createDataFrame([("Ab", 1), ("cd", 2)], "k STRING, v INT")
    right = spark.createDataFrame([("aB", "x"), ("EF", "y")], "q STRING, w STRING")
    assert lookups.case_insensitive_join(left, right, "k", "q").count() == 1
    assert [r["v"] for r in lookups.ordered_limit(left, [F.desc("v")], 1).collect()] == [2]
    keys = lookups.key_compare(left.union(left), left.filter("v = 1"), ["k"]).orderBy("k").collect()
    assert [(r["k"], r["source_rows"], r["target_rows"], r["presence"]) for r in keys] == [("Ab", 2, 1, "both"), ("cd", 2, 0, "source_only")]


def test_cluster_sessions_need_a_shared_folder():
    class Conf:
        def get(self, *_args):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
