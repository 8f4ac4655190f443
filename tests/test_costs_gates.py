from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakeproof.operators import costs, gates

GB = 2**30


def price(gb: float) -> Decimal:
    """Band by band."""
    left, total = Decimal(str(gb)), Decimal(0)
    for width, rate in ((1, "0"), (10239, "0.109"), (40960, "0.085"), (102400, "0.082"), (None, "0.080")):
        used = left if width is None else min(left, Decimal(width))
        total += used * Decimal(rate)
        left -= used
    return total


@pytest.mark.parametrize("gb", [0, 0.5, 1, 5, 10240, 10241, 51200, 153600, 153601, 11 * 1024 * 1024])
def test_egress_bands(spark, gb):
    row = spark.range(1).select(costs.egress_cost(F.lit(int(gb * GB))).alias("c")).first()
    assert row["c"] == price(gb)


def test_known_prices(spark):
    sizes = spark.createDataFrame([(10240 * GB,), (51200 * GB,)], "b BIGINT")
    got = [r["c"] for r in sizes.select(costs.egress_cost(F.col("b")).alias("c")).collect()]
    assert got == [Decimal("1116.051"), Decimal("1116.051") + Decimal("3481.6")]


def test_scenarios(spark):
    sizes = spark.createDataFrame([(100 * GB + 1,)], "size BIGINT")
    row = costs.egress_scenarios(sizes, "size", F.lit(25)).first()
    small = int(Decimal(100 * GB + 1) * Decimal("0.70"))
    assert float(row["scenario_base_usd"]) == pytest.approx(99 * 0.109, abs=1e-6)
    assert float(row["scenario_with_credits_usd"]) == pytest.approx(99 * 0.109 * 0.75, abs=1e-6)
    assert float(row["scenario_optimized_usd"]) == pytest.approx((small / GB - 1) * 0.109 * 0.75, abs=1e-6)


def test_negative_size_is_an_error(spark):
    sizes = spark.createDataFrame([(-1,)], "size BIGINT")
    with pytest.raises(PySparkException, match="must be >= 0"):
        costs.egress_scenarios(sizes, "size", F.lit(0)).collect()


def test_currencies_do_not_mix(spark):
    rows = spark.createDataFrame([("a", 1.0, "USD"), ("a", 2.0, "INR"), ("b", 3.5, "USD")], "g STRING, amount DOUBLE, currency STRING")
    sums = {(r["g"], r["currency"]): float(r["amount"]) for r in costs.money_sum(rows, ["g"]).collect()}
    assert sums == {("a", "USD"): 1.0, ("a", "INR"): 2.0, ("b", "USD"): 3.5}
    with pytest.raises(PySparkException, match="Currency mismatch"):
        costs.single_currency_total(rows, ["g"]).collect()


METRICS = "wave_id STRING, dvt_pass_rate DOUBLE, latency_increase_pct DOUBLE, data_loss_detected BOOLEAN, streaming_lag BIGINT, escalation_raised BOOLEAN"


@pytest.mark.parametrize(
    "values, triggered",
    [
        ((0.99, 20.0, False, 1000, False), []),
        ((0.9899, 20.0, False, 1000, False), ["DVT pass rate"]),
        ((1.0, 20.01, False, 0, False), ["Latency increase"]),
        ((1.0, 0.0, True, 0, False), ["Data loss"]),
        ((1.0, 0.0, False, 1001, False), ["Streaming lag"]),
        ((1.0, 0.0, False, 0, True), ["Escalation raised"]),
        ((0.5, 50.0, True, 5000, True), ["DVT pass rate", "Latency increase", "Data loss", "Streaming lag", "Escalation raised"]),
    ],
)
def test_rollback_thresholds(spark, values, triggered):
    row = gates.rollback_conditions(spark.createDataFrame([("w", *values)], METRICS)).first()
    assert [c["name"] for c in row["conditions"] if c["triggered"]] == triggered
    assert row["should_rollback"] is bool(triggered)
    assert len(row["conditions"]) == 5


def test_rollback_details_and_rejects(spark):
    rows = [("a", 0.98, 25.0, True, 2000, False), ("b", 1.2, 0.0, False, 0, False), ("c", 1.0, -1.0, False, 0, False), ("d", 1.0, 0.0, False, -5, False)]
    got = {r["wave_id"]: r for r in gates.rollback_conditions(spark.createDataFrame(rows, METRICS)).collect()}
    assert [c["details"] for c in got["a"]["conditions"]] == [
        "Pass rate 0.9800 (below 0.99 threshold)",
        "Latency increase 25.0% (exceeds 20% threshold)",
        "Data loss detected",
        "Streaming lag 2000 (exceeds 1000 threshold)",
        "No escalation raised",
    ]
    assert got["a"]["reject_reason"] is None
    assert [got[k]["reject_reason"].split()[0] for k in "bcd"] == ["dvt_pass_rate", "latency_increase_pct", "streaming_lag"]
    assert got["b"]["should_rollback"] is None


def test_gate_lists_follow_the_required_order(spark):
    rows = spark.createDataFrame(
        [("w", {"no_data_loss": True, "dvt_passed": True, "latency_ok": False, "unlisted": True}), ("all", {c: True for c in gates.REQUIRED_CRITERIA})],
        "wave_id STRING, criteria MAP<STRING,BOOLEAN>",
    )
    got = {r["wave_id"]: r for r in gates.enforce_gate(rows).collect()}
    assert got["w"]["criteria_met"] == ["dvt_passed", "no_data_loss"]
    assert got["w"]["criteria_failed"] == ["latency_ok", "streaming_stable", "dashboards_verified", "kpis_reconciled"]
    assert got["all"]["passed"] and not got["w"]["passed"]


def test_newer_gate_results_win(spark):
    rows = spark.createDataFrame([("w", "a", False, 1), ("w", "a", True, 2), ("w", "b", True, 1), ("x", "a", False, 1)],
                                 "wave_id STRING, criterion STRING, met BOOLEAN, ts INT")
    got = {r["wave_id"]: r["passed"] for r in gates.merge_gate_results(rows).collect()}
    assert got == {"w": True, "x": False}


def test_run_mode_steps(spark):
    modes = list(gates.RUN_MODE_STEPS)
    pairs = spark.createDataFrame([(a, b) for a in modes for b in modes], "a STRING, b STRING")
    legal = {
        (r["a"], r["b"])
        for r in pairs.withColumn("ok", gates.legal_transition(F.col("a"), F.col("b"), gates.RUN_MODE_STEPS)).filter("ok").collect()
    }
    assert legal == {
        ("OLD_ONLY", "SHADOW"), ("SHADOW", "REVERSE_SHADOW"), ("REVERSE_SHADOW", "NEW_ONLY"),
        ("SHADOW", "OLD_ONLY"), ("REVERSE_SHADOW", "OLD_ONLY"), ("NEW_ONLY", "OLD_ONLY"),
    }


def test_final_states_have_no_next(spark):
    row = spark.range(1).select(gates.next_states(F.lit("COMPLETED"), gates.WAVE_STATUS_STEPS).alias("n")).first()
    assert row["n"] == []


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_audit_does_not_depend_on_buckets(spark, buckets):
    modes = ["OLD_ONLY", "SHADOW", "REVERSE_SHADOW", "NEW_ONLY", "OLD_ONLY", "NEW_ONLY", "SHADOW"] * 7
    rows = spark.createDataFrame([("w", i, m) for i, m in enumerate(modes)] + [("v", 5, "SHADOW")], "wave_id STRING, ts INT, mode STRING")
    bucket = F.floor(F.col("ts") * buckets / 50)
    got = gates.transition_audit(rows, "wave_id", ["ts"], "mode", gates.RUN_MODE_STEPS, bucket, hot_rows=3)
    by_ts = {r["ts"]: (r["previous"], r["legal"]) for r in got.filter("wave_id = 'w'").collect()}
    for i, mode in enumerate(modes):
        before = modes[i - 1] if i else None
        assert by_ts[i] == (before, None if before is None else mode in gates.RUN_MODE_STEPS[before])


def test_progress_and_estimate(spark):
    rows = spark.createDataFrame([(0, 0), (5, 20), (20, 20)], "done BIGINT, total BIGINT")
    assert [r["p"] for r in rows.select(gates.transfer_progress(F.col("done"), F.col("total")).alias("p")).collect()] == [100.0, 25.0, 100.0]
    assert spark.range(1).select(gates.query_byte_estimate(F.lit("né")).alias("b")).first()["b"] == 30
    assert spark.range(1).select(gates.cutover_gate(F.lit(1000)).alias("s")).first()["s"] == "verified"
    assert spark.range(1).select(gates.cutover_gate(F.lit(1001)).alias("s")).first()["s"] == "failed"


def test_money_is_subtracted_within_a_currency(spark):
    rows = spark.createDataFrame([(10.5, "USD", 3.25, "USD"), (1.0, "INR", 2.0, "INR")], "a double, ac string, b double, bc string")
    rest = costs.money_difference(F.col("a"), F.col("ac"), F.col("b"), F.col("bc"))
    assert [float(r[0]) for r in rows.select(rest).collect()] == [7.25, -1.0]
    with pytest.raises(Exception, match="Currency mismatch: USD vs INR"):
        rows.withColumn("bc", F.lit("INR")).select(rest).collect()
