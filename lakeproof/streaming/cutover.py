"""Lag, reconciliation and windows over event streams.

Every function also takes a static DataFrame, where the watermark has no effect; that is the batch twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.operators.gates import LAG_THRESHOLD, cutover_gate


def tag_sides(source: DataFrame, target: DataFrame) -> DataFrame:
    return source.withColumn("side", F.lit("source")).unionByName(target.withColumn("side", F.lit("target")))


def stream_lag(tagged: DataFrame, job: str, ts: str = "ts", delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Per job and window: events seen on the source and not on the target yet, and the cutover verdict.

    A window comes out once the watermark has passed it; later rows are dropped and counted by Spark's
    ``numRowsDroppedByWatermark``.
    """
    counted = (
        tagged.withWatermark(ts, delay)
        .groupBy(F.window(ts, window).alias("w"), job)
        .agg(
            F.count_if(F.col("side") == "source").alias("source_events"),
            F.count_if(F.col("side") == "target").alias("target_events"),
        )
    )
    return counted.select(
        F.col("w.start").alias("window_start"),
        job,
        "source_events",
        "target_events",
        (F.col("source_events") - F.col("target_events")).alias("lag"),
    )


def gated(lag: DataFrame, threshold: int = LAG_THRESHOLD) -> DataFrame:
    return lag.withColumn("status", cutover_gate(F.col("lag"), threshold))


def stream_reconcile(
    source: DataFrame, target: DataFrame, key: str, ts: str = "ts", delay: str = "10 minutes", within: str = "1 hour", how: str = "full_outer"
) -> DataFrame:
    """Match events by key where the target's follows the source's within a time bound.

    Unmatched events come out when the watermark has passed their bound, so state stays bounded.
    """
    left = source.select(F.col(key).alias("s_key"), F.col(ts).alias("s_ts")).withWatermark("s_ts", delay)
    right = target.select(F.col(key).alias("t_key"), F.col(ts).alias("t_ts")).withWatermark("t_ts", delay)
    condition = F.expr(f"s_key = t_key AND t_ts >= s_ts AND t_ts <= s_ts + INTERVAL {within}")
    status = F.when(F.col("t_key").isNull(), "source_only").when(F.col("s_key").isNull(), "target_only").otherwise("matched")
    return left.join(right, condition, how).select(
        F.coalesce("s_key", "t_key").alias(key), "s_ts", "t_ts", status.alias("status")
    )


def stream_pair_join(source: DataFrame, target: DataFrame, key: str, ts: str = "ts", delay: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """Only the matched pairs: an inner join, so each comes out as soon as its second event arrives."""
    return stream_reconcile(source, target, key, ts, delay, within, "inner")


def stream_dedup(events: DataFrame, keys: list[str], ts: str = "ts", delay: str = "2 hours") -> DataFrame:
    """Replays within the delay are removed; state older than the watermark is forgotten."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def event_counts(events: DataFrame, event_type: str = "event_type", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Events per type and sliding window of an hour, every fifteen minutes."""
    counted = events.withWatermark(ts, delay).groupBy(F.window(ts, "1 hour", "15 minutes").alias("w"), event_type).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), event_type, "n")


def user_sessions(events: DataFrame, user: str, ts: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events less than the gap apart."""
    sessions = (
        events.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("w"), user)
        .agg(F.count("*").alias("events"), F.min(ts).alias("first_event"), F.max(ts).alias("last_event"))
    )
    return sessions.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", "first_event", "last_event")
