"""Cutover gates, rollback conditions and state transitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.functions.windows import HOT_ROWS, lag_in_buckets

# Legal steps of the run mode.
RUN_MODE_STEPS = {
    "OLD_ONLY": ("SHADOW",),
    "SHADOW": ("REVERSE_SHADOW", "OLD_ONLY"),
    "REVERSE_SHADOW": ("NEW_ONLY", "OLD_ONLY"),
    "NEW_ONLY": ("OLD_ONLY",),
}

# Legal steps of the wave status.
WAVE_STATUS_STEPS = {
    "PLANNED": ("SHADOW_RUNNING",),
    "SHADOW_RUNNING": ("REVERSE_SHADOW_RUNNING", "ROLLED_BACK"),
    "REVERSE_SHADOW_RUNNING": ("CUTOVER_READY", "ROLLED_BACK"),
    "CUTOVER_READY": ("CUTTING_OVER", "ROLLED_BACK"),
    "CUTTING_OVER": ("COMPLETED", "ROLLED_BACK"),
    "COMPLETED": (),
    "ROLLED_BACK": (),
}

# Steps of a stream cutover.
STREAM_STATUS_STEPS = {
    "active": ("draining",),
    "draining": ("switching",),
    "switching": ("verified", "failed"),
    "verified": (),
    "failed": (),
}

# Criteria of a wave gate, in reporting order.
REQUIRED_CRITERIA = (
    "dvt_passed",
    "latency_ok",
    "no_data_loss",
    "streaming_stable",
    "dashboards_verified",
    "kpis_reconciled",
)

# Rollback conditions in reporting order: name, details, and the words for triggered and not.
CONDITIONS = {
    "pass_rate": ("DVT pass rate", "Pass rate %.4f (%s 0.99 threshold)", "below", "at or above"),
    "latency": ("Latency increase", "Latency increase %.1f%% (%s 20%% threshold)", "exceeds", "within"),
    "data_loss": ("Data loss", "%s", "Data loss detected", "No data loss detected"),
    "lag": ("Streaming lag", "Streaming lag %d (%s %d threshold)", "exceeds", "within"),
    "escalation": ("Escalation raised", "%s", "Escalation raised", "No escalation raised"),
}

# Why an input row is rejected, by the column that is out of range.
REJECTS = {
    "dvt_pass_rate": "dvt_pass_rate must be between 0.0 and 1.0",
    "latency_increase_pct": "latency_increase_pct must be >= 0.0",
    "streaming_lag": "streaming_lag must be >= 0",
}

# Rollback thresholds.
MIN_PASS_RATE = 0.99
MAX_LATENCY_INCREASE_PCT = 20.0
LAG_THRESHOLD = 1000


# -- transitions ----------------------------------------------------------------------------------


def next_states(state: Column, steps: Mapping[str, Sequence[str]]) -> Column:
    """Array of the states reachable in one step; empty for unknown and final states."""
    out = F.array().cast("array<string>")
    for current, targets in steps.items():
        options = F.array(*[F.lit(t) for t in targets]).cast("array<string>")
        out = F.when(state == current, options).otherwise(out)
    return out


def legal_transition(current: Column, target: Column, steps: Mapping[str, Sequence[str]]) -> Column:
    """Whether the step is listed; a state never steps to itself unless listed."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, bs in steps.items() for b in bs]
    step = F.struct(F.coalesce(current, F.lit("")).alias("a"), F.coalesce(target, F.lit("")).alias("b"))
    return F.array_contains(F.array(*pairs), step)


def transition_audit(
    history: DataFrame,
    entity: str,
    order: Sequence[str],
    state: str,
    steps: Mapping[str, Sequence[str]],
    bucket: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Legality of each step of each entity's history; the first state of an entity has no step.

    An entity with more than ``hot_rows`` states is spread over buckets of its order instead of being sorted in one task:
    those that ``bucket`` names, which must grow with ``order``, or ranges between sampled splitters.
    """
    stepped = lag_in_buckets(history, [entity], order, bucket, state, "previous", hot_rows)
    return stepped.withColumn(
        "legal", F.when(F.col("previous").isNotNull(), legal_transition(F.col("previous"), F.col(state), steps))
    )


# -- gates ------------------------------------------------------------------------------------------


def enforce_gate(waves: DataFrame, criteria: str = "criteria", required: Sequence[str] = REQUIRED_CRITERIA) -> DataFrame:
    """Lists met and failed criteria in the given order; a missing criterion has failed."""
    names = F.array(*[F.lit(n) for n in required])
    met = lambda n: F.coalesce(F.try_element_at(F.col(criteria), n), F.lit(False))
    return waves.select(
        "*",
        F.filter(names, lambda n: met(n)).alias("criteria_met"),
        F.filter(names, lambda n: ~met(n)).alias("criteria_failed"),
    ).withColumn("passed", F.size("criteria_failed") == 0)


def merge_gate_results(
    results: DataFrame, entity: str = "wave_id", criterion: str = "criterion", met: str = "met", order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Latest result per criterion, then whether all of them are met, per entity."""
    latest = results.groupBy(entity, criterion).agg(F.max_by(met, F.struct(*order)).alias(met))
    return latest.groupBy(entity).agg(
        F.coalesce(F.bool_and(met), F.lit(True)).alias("passed"),
        F.count("*").alias("criteria"),
        F.count_if(met).alias("criteria_met"),
    )


def status_after_gate(status: Column, passed: Column) -> Column:
    """A passed gate makes a wave in reverse shadow ready for cutover."""
    return F.when(passed & (status == "REVERSE_SHADOW_RUNNING"), "CUTOVER_READY").otherwise(status)


# -- rollback -----------------------------------------------------------------------------------------


def reject_reason() -> Column:
    """Why an input row is out of range, NULL when it is not."""
    rate, latency, lag = F.col("dvt_pass_rate"), F.col("latency_increase_pct"), F.col("streaming_lag")
    return (
        F.when(~rate.between(0.0, 1.0), REJECTS["dvt_pass_rate"])
        .when(latency < 0.0, REJECTS["latency_increase_pct"])
        .when(lag < 0, REJECTS["streaming_lag"])
    )


def rollback_conditions(metrics: DataFrame, lag_threshold: int = LAG_THRESHOLD) -> DataFrame:
    """Add conditions (name, triggered, details), should_rollback and reject_reason.

    Rows with inputs out of range carry a reject_reason and no verdict.
    """
    rate, latency, lag = F.col("dvt_pass_rate"), F.col("latency_increase_pct"), F.col("streaming_lag")
    loss, escalated = F.col("data_loss_detected"), F.col("escalation_raised")

    def condition(key: str, triggered: Column, *values: Column) -> Column:
        name, text, yes, no = CONDITIONS[key]
        word = F.when(triggered, yes).otherwise(no)
        shown = [word if v is None else v for v in values]
        return F.struct(F.lit(name).alias("name"), triggered.alias("triggered"), F.format_string(text, *shown).alias("details"))

    low, slow, behind = rate < MIN_PASS_RATE, latency > MAX_LATENCY_INCREASE_PCT, lag > lag_threshold
    conditions = F.array(
        condition("pass_rate", low, rate, None),
        condition("latency", slow, latency, None),
        condition("data_loss", loss, None),
        condition("lag", behind, lag, None, F.lit(lag_threshold)),
        condition("escalation", escalated, None),
    )
    checked = metrics.withColumn("reject_reason", reject_reason())
    valid = F.col("reject_reason").isNull()
    return checked.withColumn("conditions", F.when(valid, conditions)).withColumn(
        "should_rollback", F.exists("conditions", lambda c: c["triggered"])
    )


def rollback_reason(conditions: Column) -> Column:
    names = F.transform(F.filter(conditions, lambda c: c["triggered"]), lambda c: c["name"])
    return F.when(F.size(names) > 0, F.concat(F.lit("Triggered conditions: "), F.array_join(names, ", ")))


# -- small rules ----------------------------------------------------------------------------------------


def cutover_gate(lag: Column, threshold: int = LAG_THRESHOLD) -> Column:
    """verified when the lag is within the threshold, else failed."""
    return F.when(lag <= threshold, "verified").otherwise("failed")


def transfer_progress(transferred: Column, total: Column) -> Column:
    """Percent; an empty transfer is complete."""
    return F.when(total == 0, F.lit(100.0)).otherwise(transferred / F.nullif(total, F.lit(0)) * 100)


def query_byte_estimate(sql: Column) -> Column:
    """Ten times the UTF-8 size of the query text."""
    return F.octet_length(sql).cast("bigint") * 10
