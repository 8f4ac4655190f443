"""Sinks: rewritten texts, reports, documents and the event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_type STRING, aggregate_id STRING, event_id STRING, occurred_at TIMESTAMP, payload STRING"


def _gathered(rows: DataFrame, *folders: str) -> DataFrame:
    """Bring the rows of a folder together, so that not every task writes a file to every folder.

    A rebalance is adaptive: Spark splits the rows of a large folder over several tasks.
    """
    return rows.hint("rebalance", *folders)


def write_rewritten(rewritten: DataFrame, path: str, key: str = "path", text: str = "rewritten") -> None:
    """One row per input file, keyed by its path; a table instead of one small file per row."""
    rewritten.select(key, text).write.mode("overwrite").parquet(path)


def write_report(rows: DataFrame, path: str, key: str = "inventory_id") -> None:
    """Replace the rows of the ids present, keep those of other ids."""
    (
        _gathered(rows, key)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )


def write_texts(texts: DataFrame, path: str, text: str, folders: Sequence[str] = (), file_bytes: int = 128 << 20) -> None:
    """Texts as lines of files in one folder per value, of about ``file_bytes`` each."""
    columns = [*folders, F.col(text).alias("value")]
    rows = texts.select(*columns)
    mean = rows.agg(F.avg(F.octet_length("value") + 1).alias("n")).first()["n"] or 1
    lines = max(1, int(file_bytes / mean))
    writer = (_gathered(rows, *folders) if folders else rows).write.mode("overwrite").option("maxRecordsPerFile", lines)
    (writer.partitionBy(*folders) if folders else writer).text(path)


def write_inventory(tables: DataFrame, path: str, part: Column) -> None:
    """Inventory documents as JSON lines. ``part`` splits an inventory into documents of bounded size."""
    fields = [c for c in tables.columns if c != "inventory_id"]
    documents = tables.groupBy("inventory_id", part.alias("__part")).agg(F.collect_list(F.struct(*fields)).alias("tables"))
    documents.drop("__part").write.mode("overwrite").json(path)


def event_rows(rows: DataFrame, event_type: str, aggregate_id: Column, occurred_at: Column, payload: Sequence[str]) -> DataFrame:
    """Result rows as events; the id is derived from the content, so that a repeated write is recognisable."""
    body = F.to_json(F.struct(*payload))
    return rows.select(
        F.lit(event_type).alias("event_type"),
        aggregate_id.cast("string").alias("aggregate_id"),
        F.md5(F.concat_ws("|", F.lit(event_type), aggregate_id.cast("string"), occurred_at.cast("string"), body)).alias("event_id"),
        occurred_at.cast("timestamp").alias("occurred_at"),
        body.alias("payload"),
    )


def append_events(events: DataFrame, path: str) -> None:
    _gathered(events, "event_type").write.mode("append").partitionBy("event_type").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(path)
