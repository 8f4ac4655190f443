"""Streams written batch by batch: appended tables that hold each batch once, and late rows set apart.

A batch is written to a folder of its own, named by its number. Spark gives a batch that failed half way the same number and the
same rows when it starts again, so its folder is replaced and the table holds every batch once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeproof.session import prepare
from lakeproof.sources.writers import EVENT_SCHEMA

BATCH = "batch"


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of a table; empty if none was written yet."""
    java = spark._jvm
    folder = java.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return spark.createDataFrame([], f"{schema}, {BATCH} bigint")
    return spark.read.schema(f"{schema}, {BATCH} bigint").parquet(path)


def run_batches(stream: DataFrame, base: str, write: Callable[[DataFrame, int], None]) -> None:
    """Hand each batch that is available to a writer. A second run with the same ``base`` goes on after the last whole batch."""
    prepare(stream.sparkSession)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def append_event_stream(events: DataFrame, base: str) -> DataFrame:
    """Append a stream of event rows (see ``writers.event_rows``) to an event log, each batch once; the log."""
    run_batches(events, base, lambda rows, batch: write_batch(rows.select(*_names(EVENT_SCHEMA)), f"{base}/log", batch))
    return read_batches(events.sparkSession, f"{base}/log", EVENT_SCHEMA).drop(BATCH)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def split_late(stream: DataFrame, ts: str, base: str, delay: str = "10 minutes") -> DataFrame:
    """All rows of a stream, with a column ``late``: older than the watermark when they arrived.

    The watermark of a batch is the latest time of the batches before it, less the delay, as Spark's own is. Spark drops late
    rows and counts what is left of them after a partial aggregate; here each is kept. The mark of a batch is
    written before its rows, from the batch itself, so a restart finds the same one.
    """
    spark = stream.sparkSession
    marks, rows_at = f"{base}/marks", f"{base}/rows"

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            write_batch(rows.agg(F.max(ts).alias("latest")), marks, batch)
            before = read_batches(spark, marks, "latest timestamp").filter(F.col(BATCH) < batch).agg(F.max("latest").alias("latest")).first()
            late = F.lit(False)
            if before["latest"] is not None:
                late = F.coalesce(F.col(ts) < F.lit(before["latest"]).cast("timestamp") - F.expr(f"INTERVAL {delay}"), F.lit(False))
            write_batch(rows.withColumn("late", late), rows_at, batch)
        finally:
            rows.unpersist()

    run_batches(stream, base, write)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return read_batches(spark, rows_at, f"{fields}, late boolean").drop(BATCH)


def lag_with_late_rows(split: DataFrame, job: str, ts: str = "ts", window: str = "1 hour") -> DataFrame:
    """Per job and window of rows tagged by side and lateness: events of either side, the lag, and the late rows of both.

    Late rows count as events: they are there, though a window that was closed before they came did not have them.
    """
    side = lambda name: F.count_if(F.col("side") == name)
    counted = split.groupBy(F.window(ts, window).alias("w"), job).agg(
        side("source").alias("source_events"), side("target").alias("target_events"), F.count_if("late").alias("late_rows")
    )
    lag = (F.col("source_events") - F.col("target_events")).alias("lag")
    return counted.select(F.col("w.start").alias("window_start"), job, "source_events", "target_events", lag, "late_rows")
