"""Legality of state steps on a stream: states are audited in the order of their event times."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lakeproof.operators.gates import RUN_MODE_STEPS, STREAM_STATUS_STEPS, transition_audit
from lakeproof.streaming.run import state_of

OUTPUT = "entity STRING, event_id BIGINT, previous STRING, state STRING, legal BOOLEAN"


class _StepAudit(StatefulProcessor):
    """Rows wait in the state store until the watermark has passed them, and come out ordered by (ts, event_id).

    So the batches in which rows arrive do not matter. Rows are handled one by one: entities are many and have few rows each, so a
    data frame per entity would cost more than its rows. An entity's timer is set to
    the earliest row that waits; what waits is bounded by the entity's rows within the delay.
    """

    def __init__(self, steps: Mapping[str, Sequence[str]]) -> None:
        self._legal = {(a, b) for a, targets in steps.items() for b in targets}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "state STRING")
        self._waiting = handle.getListState("waiting", "ts BIGINT, event_id BIGINT, state STRING")

    def handleInputRows(self, key, rows, timerValues):
        waiting = [(r["micros"], r["event_id"], r["state"]) for r in rows]
        if waiting:
            self._waiting.appendList(waiting)
            # a timer in the past would not fire: such a row is at the watermark and comes out with the next one
            earliest = min(micros for micros, _, _ in waiting)
            self._handle.registerTimer(max(earliest // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(row) for row in self._waiting.get()]
        later = [row for row in waiting if row[0] // 1000 >= passed]
        if later:
            self._waiting.put(later)
            self._handle.registerTimer(max(min(row[0] for row in later) // 1000, passed) + 1)
        else:
            self._waiting.clear()
        ready = sorted((row for row in waiting if row[0] // 1000 < passed), key=lambda row: (row[0], row[1] is None, row[1]))
        if not ready:
            return
        previous = self._last.get()[0] if self._last.exists() else None
        self._last.update((ready[-1][2],))
        for _, event_id, state in ready:
            yield Row(entity=key[0], event_id=event_id, previous=previous, state=state, legal=None if previous is None else (previous, state) in self._legal)
            previous = state

    def close(self) -> None:
        pass


def stream_transition_audit(
    history: DataFrame, steps: Mapping[str, Sequence[str]] = RUN_MODE_STEPS, delay: str = "10 minutes"
) -> DataFrame:
    """Audit a stream of (entity STRING, event_id BIGINT, ts TIMESTAMP, state STRING).

    The first state of an entity has no step and a NULL verdict. A state comes out once the watermark, the latest time
    seen less the delay, has passed it; rows that arrive after that are dropped as late. ``audit_tail`` has the states
    that wait when the history ends.
    """
    return (
        history.select("entity", "event_id", "ts", "state", F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 63))).alias("micros"))
        .withWatermark("ts", delay)
        .groupBy("entity")
        .transformWithState(
            statefulProcessor=_StepAudit(steps), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime"
        )
    )


def audit_tail(
    history: DataFrame, steps: Mapping[str, Sequence[str]] = RUN_MODE_STEPS, delay: str = "10 minutes"
) -> DataFrame:
    """The same audit in batch, of the states of a whole history that the stream's last watermark has not passed.

    A stream that ran to the end of the history without late rows has emitted all others, so both together are every
    row once. The state before the tail's first one is the entity's last that the stream has seen.
    """
    rows = history.select("entity", "event_id", "ts", "state")
    passed = rows.agg(F.unix_millis(F.max("ts") - F.expr(f"INTERVAL {delay}")).alias("ms")).first()["ms"]
    whole = transition_audit(rows, "entity", ["ts", "event_id"], "state", steps, F.date_trunc("minute", "ts"))
    tail = whole.filter(F.unix_millis("ts") >= F.lit(passed))
    return tail.select("entity", "event_id", "previous", "state", "legal")


def waiting_audit(spark: SparkSession, base: str, steps: Mapping[str, Sequence[str]] = RUN_MODE_STEPS) -> DataFrame:
    """The same audit of the states that wait in the checkpoint of a run, so that with what has come out every row is there once.

    ``base`` is the folder of ``run.run_to_end``. The state before an entity's first waiting one is the last that came out. What waits
    of an entity is bounded by its rows within the delay.
    """
    waiting = state_of(spark, base, "waiting").select("key.entity", "list_element.*")
    last = state_of(spark, base, "last").select("key.entity", F.col("value.state").alias("last"))
    order = Window.partitionBy("entity").orderBy("ts", "event_id")
    rows = waiting.join(last, "entity", "left").withColumn("previous", F.coalesce(F.lag("state").over(order), "last"))
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, targets in steps.items() for b in targets]
    legal = F.when(F.col("previous").isNotNull(), F.struct(F.col("previous").alias("a"), F.col("state").alias("b")).isin(*pairs))
    return rows.select("entity", "event_id", "previous", "state", legal.alias("legal"))


def cutover_status(history: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The same audit over the steps of a stream cutover."""
    return stream_transition_audit(history, STREAM_STATUS_STEPS, delay)
