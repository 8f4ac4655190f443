"""Streams over the events file, run to the end of the data.

Of windows and joins only what the watermark has passed comes out, which the SQL twins state as a bound on the latest event. Audits
return every event: what waits is read from the checkpoint. Where a query needs several triggers, the events are written as several files first.
The target side lost the cheapest events and got the others late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.operators.gates import RUN_MODE_STEPS, STREAM_STATUS_STEPS
from lakeproof.plans.registry import Registry, Tables
from lakeproof.session import scratch_path
from lakeproof.sources import writers
from lakeproof.streaming import batches, cutover, transitions
from lakeproof.streaming.run import file_stream, run_available, run_to_end, table_stream

REG = Registry()
col, lit = F.col, F.lit


def events_stream(t: Tables) -> DataFrame:
    stream = table_stream(t.spark, t.path("events"), t.events.schema)
    return stream.withColumn("ts", col("ts").cast("timestamp"))


def target_stream(t: Tables) -> DataFrame:
    # as many minutes late as the value says
    late = col("ts") + F.make_dt_interval(mins=col("value").cast("int"))
    return events_stream(t).filter("value >= 2").withColumn("ts", late)


_TARGET_SQL = "SELECT * REPLACE (ts + to_minutes(CAST(trunc(value) AS INTEGER)) AS ts) FROM events WHERE value >= 2"
_BOTH_SQL = f"SELECT *, 'source' AS side FROM events UNION ALL SELECT *, 'target' FROM ({_TARGET_SQL})"
_SEEN_SQL = f"(SELECT max(ts) - INTERVAL 10 MINUTE FROM ({_BOTH_SQL}))"


def ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[col(c).cast("timestamp_ntz").alias(c) if c in names else col(c) for c in df.columns])


def lag_stream(t: Tables) -> DataFrame:
    return cutover.stream_lag(cutover.tag_sides(events_stream(t), target_stream(t)), "event_type")


_LAG_SQL = f"""
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) FILTER (WHERE side = 'source') AS source_events,
       count(*) FILTER (WHERE side = 'target') AS target_events,
       count(*) FILTER (WHERE side = 'source') - count(*) FILTER (WHERE side = 'target') AS lag
FROM ({_BOTH_SQL}) GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_SEEN_SQL}
"""
REG.add("stream_lag", lambda t: ntz(run_available(lag_stream(t), "lag"), "window_start"), _LAG_SQL)
REG.add("stream_cutover_gate",
        lambda t: ntz(run_available(cutover.gated(lag_stream(t), 2), "gate"), "window_start").select("window_start", "event_type", "lag", "status"),
        f"SELECT window_start, event_type, lag, CASE WHEN lag <= 2 THEN 'verified' ELSE 'failed' END AS status FROM ({_LAG_SQL})")

# both sides must have passed: the smaller of the two watermarks counts
_JOIN_SEEN_SQL = f"least((SELECT max(ts) FROM events), (SELECT max(ts) FROM ({_TARGET_SQL}))) - INTERVAL 10 MINUTE"
REG.add("stream_reconcile",
        lambda t: run_available(cutover.stream_reconcile(events_stream(t), target_stream(t), "event_id"), "reconcile").select("event_id", "status"),
        f"""WITH tgt AS ({_TARGET_SQL}), m AS (SELECT s.event_id FROM events s JOIN tgt t ON s.event_id = t.event_id AND t.ts >= s.ts AND t.ts <= s.ts + INTERVAL 1 HOUR)
        SELECT event_id, 'matched' AS status FROM m
        UNION ALL SELECT event_id, 'source_only' FROM events WHERE event_id NOT IN (SELECT event_id FROM m) AND ts + INTERVAL 1 HOUR < {_JOIN_SEEN_SQL}
        UNION ALL SELECT event_id, 'target_only' FROM tgt WHERE event_id NOT IN (SELECT event_id FROM m) AND ts < {_JOIN_SEEN_SQL}""")  # fmt: skip
REG.add("stream_pair_join",
        lambda t: ntz(run_available(cutover.stream_pair_join(events_stream(t), target_stream(t), "event_id"), "pairs"), "s_ts", "t_ts"),
        f"""SELECT s.event_id, s.ts AS s_ts, t.ts AS t_ts, 'matched' AS status FROM events s JOIN ({_TARGET_SQL}) t
            ON s.event_id = t.event_id AND t.ts >= s.ts AND t.ts <= s.ts + INTERVAL 1 HOUR""")  # fmt: skip
REG.add("stream_dedup",
        lambda t: run_available(
            cutover.stream_dedup(events_stream(t).unionByName(target_stream(t)), ["event_id"]).select("event_id", "user_id", "event_type"), "dedup"),
        "SELECT event_id, user_id, event_type FROM events")

_STATE = {
    "view": "OLD_ONLY", "click": "SHADOW", "signup": "REVERSE_SHADOW", "purchase": "NEW_ONLY", "error": "OLD_ONLY",
}
_STATUS = {"view": "active", "click": "draining", "signup": "switching", "purchase": "verified", "error": "failed"}


def _history(events: DataFrame, states: dict[str, str]) -> DataFrame:
    mapping = F.create_map(*[lit(x) for pair in states.items() for x in pair])
    return events.withColumn("ts", col("ts").cast("timestamp")).select(
        col("user_id").cast("string").alias("entity"), "event_id", "ts", mapping[col("event_type")].alias("state")
    )


def _audit_sql(states: dict[str, str], legal: str) -> str:
    state = f"CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in states.items())} END"
    return f"""WITH h AS (SELECT CAST(user_id AS VARCHAR) AS entity, event_id, ts, {state} AS state,
                     lag({state}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
        SELECT entity, event_id, coalesce(previous, '') AS previous, state,
               CASE WHEN previous IS NULL THEN 'first' WHEN (previous, state) IN {legal} THEN 'legal' ELSE 'illegal' END AS verdict
        FROM h"""


def _verdicts(audited: DataFrame) -> DataFrame:
    verdict = F.when(col("legal").isNull(), "first").when(col("legal"), "legal").otherwise("illegal")
    return audited.select("entity", "event_id", F.coalesce("previous", lit("")).alias("previous"), "state", verdict.alias("verdict"))


def audit_in_two_runs(t: Tables, states: dict[str, str], steps) -> DataFrame:
    """The events before and from the middle of the time, a trigger each; the second run goes on from the first one's checkpoint."""
    base = scratch_path(t.spark, "audit")
    middle = t.events.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("ts")).first()["ts"]
    for part in (col("ts") < lit(middle), col("ts") >= lit(middle)):
        t.events.filter(part).write.mode("append").parquet(f"{base}/events")
        history = _history(file_stream(t.spark, f"{base}/events", "*.parquet", t.events.schema), states)
        passed = run_to_end(transitions.stream_transition_audit(history, steps), base)
    return _verdicts(passed.unionByName(transitions.waiting_audit(t.spark, base, steps)))


REG.add("stream_transition_audit",
        lambda t: audit_in_two_runs(t, _STATE, RUN_MODE_STEPS),
        _audit_sql(_STATE, "(('OLD_ONLY', 'SHADOW'), ('SHADOW', 'REVERSE_SHADOW'), ('SHADOW', 'OLD_ONLY'), ('REVERSE_SHADOW', 'NEW_ONLY'), ('REVERSE_SHADOW', 'OLD_ONLY'), ('NEW_ONLY', 'OLD_ONLY'))"))
REG.add("cutover_status",
        lambda t: audit_in_two_runs(t, _STATUS, STREAM_STATUS_STEPS),
        _audit_sql(_STATUS, "(('active', 'draining'), ('draining', 'switching'), ('switching', 'verified'), ('switching', 'failed'))"))


def late_lag(t: Tables) -> DataFrame:
    """Events of two triggers, of which the second has a tenth of all times again."""
    base = scratch_path(t.spark, "late")
    for part in ("event_id % 10 <> 0", "event_id % 10 = 0"):
        t.events.filter(part).coalesce(1).write.mode("append").parquet(f"{base}/events")
    events = file_stream(t.spark, f"{base}/events", "*.parquet", t.events.schema, files_per_trigger=1).withColumn("ts", col("ts").cast("timestamp"))
    tagged = events.withColumn("side", F.explode(F.expr("IF(value >= 2, array('source', 'target'), array('source'))")))
    return ntz(batches.lag_with_late_rows(batches.split_late(tagged, "ts", f"{base}/run"), "event_type"), "window_start")


REG.add("stream_lag_late", late_lag,
        """WITH b AS (SELECT *, 'source' AS side FROM events UNION ALL SELECT *, 'target' FROM events WHERE value >= 2)
        SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) FILTER (side = 'source') AS source_events, count(*) FILTER (side = 'target') AS target_events,
          count(*) FILTER (side = 'source') - count(*) FILTER (side = 'target') AS lag,
          count(*) FILTER (event_id % 10 = 0 AND ts < (SELECT max(ts) FROM events WHERE event_id % 10 <> 0) - INTERVAL 10 MINUTE) AS late_rows
        FROM b GROUP BY 1, 2""")  # fmt: skip


def event_log_stream(t: Tables) -> DataFrame:
    """Event rows of four files, in a trigger each."""
    base = scratch_path(t.spark, "log")
    t.events.repartition(4, "event_id").write.parquet(f"{base}/events")
    events = file_stream(t.spark, f"{base}/events", "*.parquet", t.events.schema, files_per_trigger=1)
    rows = writers.event_rows(events.withColumn("detail", col("user_id").cast("string")), "EventSeen", col("event_id"), col("ts"), ["detail", "event_type"])
    log = batches.append_event_stream(rows, f"{base}/run")
    return ntz(log, "occurred_at").select("event_type", "aggregate_id", "occurred_at", F.get_json_object("payload", "$.detail").alias("detail"))


REG.add("stream_event_log", event_log_stream,
        "SELECT 'EventSeen' AS event_type, CAST(event_id AS VARCHAR) AS aggregate_id, ts AS occurred_at, CAST(user_id AS VARCHAR) AS detail FROM events")

_EVENTS_SEEN_SQL = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
REG.add("event_counts",
        lambda t: ntz(run_available(cutover.event_counts(events_stream(t)), "counts"), "window_start"),
        f"""WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS window_start, event_type FROM events, range(0, 4) r(i))
            SELECT window_start, event_type, count(*) AS n FROM w GROUP BY 1, 2 HAVING window_start + INTERVAL 1 HOUR <= {_EVENTS_SEEN_SQL}""")  # fmt: skip
REG.add("user_sessions",
        lambda t: ntz(run_available(cutover.user_sessions(events_stream(t), "user_id"), "sessions"), "session_start", "session_end", "first_event", "last_event"),
        f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER o < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
            n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
            SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events, min(ts) AS first_event, max(ts) AS last_event
            FROM n GROUP BY user_id, session HAVING max(ts) + INTERVAL 30 MINUTE <= {_EVENTS_SEEN_SQL}""")  # fmt: skip
