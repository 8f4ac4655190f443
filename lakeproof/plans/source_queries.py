"""Scans and sinks: each query writes a table-derived folder below the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeproof.operators import compare
from lakeproof.plans.altered import CUSTOMER_TARGET_SQL, customer_target
from lakeproof.plans.inventory_queries import CLASSIFIED_SQL, INVENTORY_SQL, classified, customer_inventory
from lakeproof.plans.registry import Registry, Tables
from lakeproof.plans.text_queries import WORKFLOW_SQL, workflows
from lakeproof.session import scratch_path
from lakeproof.sources import readers, writers

REG = Registry()
col, lit = F.col, F.lit


@REG.query(
    "scan_inventory",
    f"""SELECT inventory_id, database, table_name, size_bytes, row_count, coalesce(strftime(last_queried, '%Y-%m-%d'), '') AS last_queried,
        partitioned, format, has_maps FROM ({INVENTORY_SQL})""",
)
def _inventory(t: Tables):
    path = scratch_path(t.spark, "inventory")
    # documents of up to a thousand tables, by the number in their name
    writers.write_inventory(customer_inventory(t), path, F.floor(F.substring("table_name", 10, 9).cast("bigint") / 1000))
    tables = readers.scan_inventory(t.spark, path, multi_line=False)
    return tables.withColumn("last_queried", F.coalesce(F.date_format("last_queried", "yyyy-MM-dd"), lit("")))


def _text_folder(t: Tables) -> str:
    path = scratch_path(t.spark, "texts")
    writers.write_texts(t.documents, path, "text", ["source"])
    return path


_FOLDER = r"source=([^/]+)/"


@REG.query(
    "scan_text_corpus",
    "SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS characters FROM documents GROUP BY 1",
)
def _texts(t: Tables):
    files = readers.scan_text_corpus(t.spark, _text_folder(t), glob="*.txt")
    return files.groupBy(F.regexp_extract("path", _FOLDER, 1).alias("source")).agg(
        F.sum(F.length("content").cast("bigint")).alias("characters")
    )


@REG.query(
    "scan_file_listing",
    "SELECT source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents GROUP BY 1",
)
def _listing(t: Tables):
    files = readers.scan_file_listing(t.spark, _text_folder(t), glob="*.txt")
    return files.groupBy(F.regexp_extract("path", _FOLDER, 1).alias("source")).agg(F.sum("length").alias("bytes"))


@REG.query("scan_kv_json", "SELECT 'doc-' || doc_id AS name, md5(text) AS value FROM documents")
def _kv(t: Tables):
    path = scratch_path(t.spark, "bodies")
    # objects of up to a hundred names each
    entry = F.struct(F.concat(lit("doc-"), col("doc_id").cast("string")), col("text"))
    objects = t.documents.groupBy(F.floor(col("doc_id") / 100).alias("part")).agg(F.collect_list(entry).alias("entries"))
    writers.write_texts(objects.select(F.to_json(F.map_from_entries("entries")).alias("body")), path, "body")
    return readers.scan_kv_json(t.spark, path, whole_file=False).select("name", F.md5("value").alias("value"))


@REG.query(
    "scan_json_records",
    f"""WITH tgt AS ({CUSTOMER_TARGET_SQL})
        SELECT 'balance-' || a.c_custkey AS name, a.c_acctbal AS legacy_value, b.c_acctbal AS new_value, CAST(0.02 AS DOUBLE) AS tolerance_pct,
               round(b.c_acctbal - a.c_acctbal, 6) AS difference, abs(b.c_acctbal - a.c_acctbal) <= abs(a.c_acctbal) * 0.02 / 100 AS matched
        FROM customer a JOIN tgt b ON a.c_custkey = b.c_custkey""",
)
def _records(t: Tables):
    path = scratch_path(t.spark, "kpis")
    new = customer_target(t.customer).select("c_custkey", col("c_acctbal").alias("new_value"))
    kpis = t.customer.join(new, "c_custkey").select(
        "c_custkey", F.concat(lit("balance-"), col("c_custkey").cast("string")).alias("name"),
        col("c_acctbal").alias("legacy_value"), "new_value", lit(0.02).alias("tolerance_pct"),
    )
    # arrays of up to a hundred records each
    record = F.struct("name", "legacy_value", "new_value", "tolerance_pct")
    arrays = kpis.groupBy(F.floor(col("c_custkey") / 100).alias("part")).agg(F.collect_list(record).alias("records"))
    writers.write_texts(arrays.select(F.to_json("records").alias("body")), path, "body")
    records = readers.scan_json_records(t.spark, path, "kpis", multi_line=False)
    return compare.reconcile_kpis(records).withColumn("difference", F.round("difference", 6))


@REG.query("write_rewritten", f"SELECT path, md5(rewritten) AS rewritten FROM ({WORKFLOW_SQL})")
def _rewritten(t: Tables):
    path = scratch_path(t.spark, "rewritten")
    writers.write_rewritten(workflows(t), path)
    return t.spark.read.parquet(path).select("path", F.md5("rewritten").alias("rewritten"))


@REG.query(
    "write_report",
    f"""SELECT inventory_id, table_name, CASE WHEN inventory_id = 'inventory-3' THEN 'reviewed' ELSE tier END AS tier
        FROM ({CLASSIFIED_SQL})""",
)
def _report(t: Tables):
    path = scratch_path(t.spark, "report")
    rows = classified(t).select("inventory_id", "table_name", "tier")
    writers.write_report(rows, path)
    # saving one inventory again replaces its rows only
    writers.write_report(rows.filter("inventory_id = 'inventory-3'").withColumn("tier", lit("reviewed")), path)
    return t.spark.read.parquet(path)


@REG.query(
    "event_log",
    """SELECT 'OrderReceived' AS event_type, CAST(o_orderkey AS VARCHAR) AS aggregate_id, o_orderdate AS occurred_at, o_orderpriority AS detail FROM orders
       UNION ALL SELECT 'UserSeen', CAST(user_id AS VARCHAR), max(ts), CAST(count(*) AS VARCHAR) FROM events GROUP BY user_id""",
)
def _events(t: Tables):
    path = scratch_path(t.spark, "events")
    orders = t.orders.withColumnRenamed("o_orderpriority", "detail")
    users = t.events.groupBy("user_id").agg(F.max("ts").alias("ts"), F.count("*").cast("string").alias("detail"))
    writers.append_events(writers.event_rows(orders, "OrderReceived", col("o_orderkey"), col("o_orderdate"), ["detail"]), path)
    writers.append_events(writers.event_rows(users, "UserSeen", col("user_id"), col("ts"), ["detail"]), path)
    return _with_detail(writers.read_events(t.spark, path))


def _with_detail(events):
    return events.select(
        "event_type", "aggregate_id", col("occurred_at").cast("timestamp_ntz").alias("occurred_at"),
        F.get_json_object("payload", "$.detail").alias("detail"),
    )
