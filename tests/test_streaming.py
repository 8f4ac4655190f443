"""Streams of several files against their batch twins."""

from __future__ import annotations

from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lakeproof.operators.gates import RUN_MODE_STEPS
from lakeproof.sources import writers
from lakeproof.streaming import batches, cutover, transitions
from lakeproof.streaming.run import file_stream, run_available, run_to_end, table_stream

SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id STRING, kind STRING"
START = datetime(2025, 1, 1)
END = START + timedelta(days=2)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Five files in time order, each a batch, and a last late event that moves the watermark past the rest."""
    folder = str(tmp_path_factory.mktemp("events"))
    rows = [(i, START + timedelta(minutes=7 * i, seconds=i % 11), f"u{i % 3}", "abc"[i % 3]) for i in range(200)]
    rows.append((9999, END, "u0", "a"))
    for part in range(0, len(rows), 41):
        spark.createDataFrame(rows[part : part + 41], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, files):
    return file_stream(spark, files, "*.parquet", SCHEMA, files_per_trigger=1)


def before_end(df, column):
    return sorted(map(tuple, df.filter(F.col(column) < F.lit(END - timedelta(hours=2))).collect()))


def test_lag(spark, files):
    tagged = cutover.tag_sides(stream(spark, files), stream(spark, files).filter("event_id % 5 <> 0 OR event_id = 9999"))
    static = spark.read.parquet(files)
    twin = cutover.stream_lag(cutover.tag_sides(static, static.filter("event_id % 5 <> 0 OR event_id = 9999")), "kind")
    got = before_end(run_available(cutover.stream_lag(tagged, "kind"), "lag"), "window_start")
    assert got == before_end(twin, "window_start") and len(got) > 20
    assert any(r[-1] > 0 for r in got)
    assert {r["status"] for r in cutover.gated(twin, 0).collect()} == {"verified", "failed"}


def test_counts_and_sessions(spark, files):
    static = spark.read.parquet(files)
    counts = run_available(cutover.event_counts(stream(spark, files), "kind"), "counts")
    assert before_end(counts, "window_start") == before_end(cutover.event_counts(static, "kind"), "window_start")
    sessions = run_available(cutover.user_sessions(stream(spark, files), "user_id"), "sessions")
    assert before_end(sessions, "session_end") == before_end(cutover.user_sessions(static, "user_id"), "session_end")


def test_reconcile(spark, files):
    late = lambda df: df.filter("event_id % 4 <> 1").withColumn(
        "ts", F.col("ts") + F.make_dt_interval(mins=F.when((F.col("event_id") % 4 == 2) & (F.col("event_id") < 9000), 90).otherwise(5))
    )
    static = spark.read.parquet(files)
    got = run_available(cutover.stream_reconcile(stream(spark, files), late(stream(spark, files)), "event_id"), "reconcile")
    twin = cutover.stream_reconcile(static, late(static), "event_id")
    both = [sorted((r["event_id"], r["status"]) for r in df.filter("event_id < 200").collect()) for df in (got, twin)]
    assert both[0] == both[1]
    assert {s for _, s in both[0]} == {"matched", "source_only", "target_only"}


def test_replays_are_removed(spark, files):
    replays = stream(spark, files).unionByName(stream(spark, files).withColumn("ts", F.col("ts") + F.expr("INTERVAL 3 MINUTES")))
    got = run_available(cutover.stream_dedup(replays, ["event_id"]), "dedup")
    assert sorted(r["event_id"] for r in got.collect()) == [*range(200), 9999]
    assert cutover.stream_dedup(spark.read.parquet(files), ["event_id"]).count() == 201


MODES = ("OLD_ONLY", "SHADOW", "REVERSE_SHADOW", "NEW_ONLY")


def audited(rows):
    """(entity, event_id) -> (previous, state, legal) in the order of (ts, event_id)."""
    out, last = {}, {}
    for event_id, _, entity, state in sorted(rows, key=lambda r: (r[1], r[0])):
        before = last.get(entity)
        out[entity, event_id] = (before, state, None if before is None else state in RUN_MODE_STEPS[before])
        last[entity] = state
    return out


@pytest.mark.parametrize(("entities", "n", "files_per_trigger"), [(3, 400, 1), (1, 30_000, None), (1, 30_000, 1), (7, 2000, 2)])
def test_audit_is_in_event_time_order(spark, tmp_path, entities, n, files_per_trigger):
    """Files are sorted by a hash, not by time; a last event moves the watermark past all others."""
    rows = [(i, START + timedelta(seconds=37 * i), f"u{i % entities}", MODES[i * 7919 % 4]) for i in range(n)]
    schema = "event_id BIGINT, ts TIMESTAMP, entity STRING, state STRING"
    shuffled = sorted(rows, key=lambda r: hash((r[0] * 2654435761) % 4294967291))
    folder = str(tmp_path / "history")
    step = -(-n // 4)
    for part in range(0, n, step):
        spark.createDataFrame(shuffled[part : part + step], schema).coalesce(1).write.mode("append").parquet(folder)
    end = START + timedelta(days=90)
    spark.createDataFrame([(-1, end, "end", "SHADOW")], schema).coalesce(1).write.mode("append").parquet(folder)
    history = table_stream(spark, folder, schema, files_per_trigger=files_per_trigger)
    got = run_available(transitions.stream_transition_audit(history, delay="60 days"), "audit").collect()
    assert {(r["entity"], r["event_id"]): (r["previous"], r["state"], r["legal"]) for r in got} == audited(rows)
    assert len(got) == n


def test_stream_and_tail_are_every_row_once(spark, tmp_path):
    rows = [(i, START + timedelta(seconds=37 * i, milliseconds=i % 3), f"u{i % 3}", MODES[i * 7919 % 4]) for i in range(200)]
    schema = "event_id BIGINT, ts TIMESTAMP, entity STRING, state STRING"
    folder = str(tmp_path / "history")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    emitted = run_available(transitions.stream_transition_audit(table_stream(spark, folder, schema)), "audit").collect()
    tail = transitions.audit_tail(spark.read.parquet(folder)).collect()
    assert len(tail) == 17 and len(emitted) + len(tail) == len(rows)
    assert {(r["entity"], r["event_id"]): (r["previous"], r["state"], r["legal"]) for r in emitted + tail} == audited(rows)
    assert transitions.audit_tail(spark.createDataFrame([], schema)).collect() == []


def test_tables_are_files_or_folders(spark, files, tmp_path):
    static = spark.read.parquet(files)
    one = str(tmp_path / "one.parquet")
    static.coalesce(1).toPandas().to_parquet(one)
    for path in (files, files + "/", one):
        assert run_available(table_stream(spark, path, SCHEMA).select("event_id"), "read").count() == static.count()
    with pytest.raises(FileNotFoundError):
        file_stream(spark, files, "*.nothing", SCHEMA)


def test_settings_are_restored_when_a_stream_does_not_start(spark, files):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(Exception, match="(?i)append|supported"):
        run_available(stream(spark, files).groupBy("kind").count(), "bad")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_audit_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = "entity STRING, event_id BIGINT, ts TIMESTAMP, state STRING"
    states = ["OLD_ONLY", "SHADOW", "REVERSE_SHADOW", "NEW_ONLY"]
    rows = [(f"e{i % 7}", i, START + timedelta(seconds=97 * i), states[(i // 7 + i % 3) % 4]) for i in range(300)]
    parts = [rows[:100], rows[100:120], rows[120:]]
    whole = str(tmp_path / "whole")

    def written(folder, part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        return file_stream(spark, folder, "*.parquet", schema, files_per_trigger=1)

    results = []
    for base, runs in ((whole, [rows]), (str(tmp_path / "parts"), parts)):
        for part in runs:
            passed = run_to_end(transitions.stream_transition_audit(written(f"{base}/events", part)), base)
        results.append(sorted(map(tuple, passed.unionByName(transitions.waiting_audit(spark, base)).collect())))
        assert passed.count() < len(rows)
    assert results[0] == results[1] and len(results[0]) == len(rows)
    last = {}
    for entity, event, _, state in rows:
        previous = last.get(entity)
        assert (entity, event, previous, state, None if previous is None else state in RUN_MODE_STEPS[previous]) in results[0]
        last[entity] = state


def test_a_batch_that_failed_half_way_is_there_once(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "log")
    rows = [(i, START + timedelta(minutes=i)) for i in range(30)]
    for part in (rows[:10], rows[10:20], rows[20:]):
        spark.createDataFrame(part, "id BIGINT, ts TIMESTAMP").coalesce(1).write.mode("append").parquet(f"{base}/events")
    stream = file_stream(spark, f"{base}/events", "*.parquet", "id BIGINT, ts TIMESTAMP", files_per_trigger=1)
    events = writers.event_rows(stream, "Seen", F.col("id"), F.col("ts"), ["id"])
    real, failures = batches.write_batch, []

    def half(rows, path, batch):
        if batch == 1 and not failures:
            failures.append(batch)
            real(rows.filter("CAST(aggregate_id AS INT) % 2 = 0"), path, batch)
            raise RuntimeError("lost after half of the batch")
        real(rows, path, batch)

    monkeypatch.setattr(batches, "write_batch", half)
    with pytest.raises(Exception, match="lost after half"):
        batches.append_event_stream(events, base)
    for _ in range(2):  # a run without new files changes nothing
        log = batches.append_event_stream(events, base)
        assert sorted(int(r["aggregate_id"]) for r in log.collect()) == list(range(30))
    assert failures == [1]


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    base = str(tmp_path / "late")
    batch_rows = [[(1, 0), (2, 60)], [(3, 49), (4, 50), (5, 61), (6, None)], [(7, 50), (8, 51), (9, 200)]]
    for part in batch_rows:
        data = [(i, None if m is None else START + timedelta(minutes=m), "x", s) for i, m in part for s in ("source", "target")[: 1 + i % 2]]
        spark.createDataFrame(data, "id BIGINT, ts TIMESTAMP, kind STRING, side STRING").coalesce(1).write.mode("append").parquet(f"{base}/events")
    stream = file_stream(spark, f"{base}/events", "*.parquet", "id BIGINT, ts TIMESTAMP, kind STRING, side STRING", files_per_trigger=1)
    split = batches.split_late(stream, "ts", f"{base}/run")
    rows = {r["id"]: r["late"] for r in split.collect()}
    assert rows == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True, 8: False, 9: False}
    lag = {r["window_start"]: tuple(r)[2:] for r in batches.lag_with_late_rows(split, "kind").collect()}
    assert lag[START] == (5, 3, 2, 4)
    assert batches.read_batches(spark, f"{base}/nothing", "id BIGINT").collect() == []


class _Held:
    """A state variable in memory that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def _set(self, value):
        self.value, self.calls = value, self.calls + 1

    update = put = _set

    def appendList(self, rows):
        self._set([*(self.value or []), *rows])

    def get(self):
        self.calls += 1
        return iter(self.value) if isinstance(self.value, list) else self.value

    def exists(self):
        return self.value is not None

    def clear(self):
        self._set(None)


def test_audit_handles_plain_rows(spark):
    """An entity's rows need no data frame: state is written once per batch and read once per timer."""
    last, waiting, timers = _Held(), _Held(), []
    handle = SimpleNamespace(getValueState=lambda *_: last, getListState=lambda *_: waiting, registerTimer=timers.append)
    audit = transitions._StepAudit({"a": ["b"]})
    audit.init(handle)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    rows = [Row(micros=m, event_id=n, state=s) for m, n, s in ((9000, 4, "a"), (2000, 2, "b"), (1000, 1, "a"), (2000, 3, "a"))]
    assert list(audit.handleInputRows(("e",), iter(rows), at(0))) == [] and (waiting.calls, timers) == (1, [2])
    out = [tuple(r) for r in audit.handleExpiredTimer(("e",), at(5), None)]
    assert out == [("e", 1, None, "a", None), ("e", 2, "a", "b", True), ("e", 3, "b", "a", False)]
    assert (waiting.value, last.value, timers) == ([(9000, 4, "a")], ("a",), [2, 10])
    assert [tuple(r) for r in audit.handleExpiredTimer(("e",), at(10), None)] == [("e", 4, "a", "a", False)] and waiting.value is None
