"""Costs, gates, rollback conditions and state histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.operators import costs, gates
from lakeproof.plans.registry import Registry, Tables

REG = Registry()
col, lit = F.col, F.lit

# -- costs: the sold value of a supplier, scaled so that every price band occurs --------------------

_SIZE_SQL = """
SELECT l_suppkey, CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18,2))) * (CASE WHEN l_suppkey % 4 = 0 THEN 20
       WHEN l_suppkey % 4 = 1 THEN 200000 WHEN l_suppkey % 4 = 2 THEN 2000000 ELSE 8000000 END)) AS BIGINT) AS size_bytes
FROM lineitem GROUP BY l_suppkey
"""


def supplier_sizes(t: Tables) -> DataFrame:
    scale = (
        F.when(col("l_suppkey") % 4 == 0, 20)
        .when(col("l_suppkey") % 4 == 1, 200000)
        .when(col("l_suppkey") % 4 == 2, 2000000)
        .otherwise(8000000)
    )
    value = t.lineitem.groupBy("l_suppkey").agg(F.sum(col("l_extendedprice").cast("decimal(18,2)")).alias("v"))
    return value.select("l_suppkey", F.floor(col("v") * scale).cast("bigint").alias("size_bytes"))


def _cost_sql(size: str) -> str:
    """Band by band in doubles, to six decimals."""
    gb = f"({size} / 1073741824.0)"
    return f"""round(greatest(least({gb}, 10240) - 1, 0) * 0.109 + greatest(least({gb}, 51200) - 10240, 0) * 0.085
        + greatest(least({gb}, 153600) - 51200, 0) * 0.082 + greatest({gb} - 153600, 0) * 0.080, 6)"""


def usd(c):
    return F.round(c, 6).cast("double")


REG.add("egress_cost",
        lambda t: supplier_sizes(t).select("l_suppkey", "size_bytes", usd(costs.egress_cost(col("size_bytes"))).alias("cost_usd")),
        f"SELECT l_suppkey, size_bytes, {_cost_sql('size_bytes')} AS cost_usd FROM ({_SIZE_SQL})")
REG.add("egress_with_credits",
        lambda t: supplier_sizes(t).select("l_suppkey", usd(costs.egress_with_credits(col("size_bytes"), lit(25))).alias("cost_usd")),
        f"SELECT l_suppkey, round({_cost_sql('size_bytes').replace(', 6)', ', 12)')} * 0.75, 6) AS cost_usd FROM ({_SIZE_SQL})")


@REG.query(
    "egress_scenarios",
    f"""WITH s AS (SELECT s_nationkey, sum(size_bytes) AS total FROM ({_SIZE_SQL}) JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
    c AS (SELECT s_nationkey, CAST(total AS BIGINT) AS size_bytes, CAST(floor(CAST(total AS BIGINT) * 0.70) AS BIGINT) AS small FROM s)
    SELECT s_nationkey, size_bytes, {_cost_sql('size_bytes')} AS base_usd,
           round({_cost_sql('size_bytes').replace(', 6)', ', 12)')} * 0.875, 6) AS with_credits_usd,
           round({_cost_sql('small').replace(', 6)', ', 12)')} * 0.875, 6) AS optimized_usd FROM c""",
)
def _scenarios(t: Tables):
    per_nation = (
        supplier_sizes(t)
        .join(t.supplier, col("l_suppkey") == col("s_suppkey"))
        .groupBy("s_nationkey")
        .agg(F.sum("size_bytes").alias("size_bytes"))
    )
    out = costs.egress_scenarios(per_nation, "size_bytes", lit(12.5))
    return out.select(
        "s_nationkey", "size_bytes", usd(col("scenario_base_usd")).alias("base_usd"),
        usd(col("scenario_with_credits_usd")).alias("with_credits_usd"), usd(col("scenario_optimized_usd")).alias("optimized_usd"),
    )


def _money(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_custkey", "o_orderstatus", col("o_totalprice").alias("amount"),
        F.when(col("o_orderpriority") == "5-LOW", "INR").otherwise("USD").alias("currency"),
    )


REG.add("money_sum",
        lambda t: costs.money_sum(_money(t), ["o_custkey"]).select("o_custkey", "currency", col("amount").cast("double").alias("amount")),
        """SELECT o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'INR' ELSE 'USD' END AS currency,
           CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS amount FROM orders GROUP BY 1, 2""")  # fmt: skip
REG.add("money_difference",
        lambda t: t.orders.select("o_orderkey", costs.money_difference(col("o_totalprice"), F.lit("USD"), F.floor(col("o_totalprice") / 7), F.lit("USD")).cast("double").alias("rest")),
        "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(28,6)) - CAST(floor(o_totalprice / 7) AS DECIMAL(28,6)) AS DOUBLE) AS rest FROM orders")
REG.add("money_sum_one_currency",
        lambda t: costs.single_currency_total(_money(t).filter("currency = 'USD'"), ["o_orderstatus"]).select("o_orderstatus", "currency", col("amount").cast("double").alias("amount")),
        """SELECT o_orderstatus, 'USD' AS currency, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS amount
           FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1""")  # fmt: skip

# -- wave metrics per nation ---------------------------------------------------------------------------

_METRICS_SQL = """
SELECT c_nationkey AS wave_id, round(1 - count(*) FILTER (WHERE o_totalprice < 8000) / count(*), 4) AS dvt_pass_rate,
  round(100 * (count(*) FILTER (WHERE o_orderpriority = '1-URGENT') - count(*) FILTER (WHERE o_orderpriority = '5-LOW'))
        / count(*), 1) + 0.0 AS latency_increase_pct,
  count(*) FILTER (WHERE o_totalprice < 1200) > 0 AS data_loss_detected,
  count(*) FILTER (WHERE o_orderstatus = 'P') * 5 AS streaming_lag,
  count(*) FILTER (WHERE o_orderstatus = 'P' AND o_totalprice > 499000) > 0 AS escalation_raised
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
"""


def wave_metrics(t: Tables) -> DataFrame:
    # counted per customer before the join, so that a customer with most orders is one row in it
    low, status = col("o_totalprice"), col("o_orderstatus")
    per_customer = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("n"),
        F.count_if(low < 8000).alias("low"),
        F.count_if(low < 1200).alias("lost"),
        F.count_if(col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.count_if(col("o_orderpriority") == "5-LOW").alias("relaxed"),
        F.count_if(status == "P").alias("pending"),
        F.count_if((status == "P") & (low > 499000)).alias("escalated"),
    )
    n = F.sum("n")
    return per_customer.join(t.customer, col("o_custkey") == col("c_custkey")).groupBy(col("c_nationkey").alias("wave_id")).agg(
        F.round(1 - F.sum("low") / n, 4).alias("dvt_pass_rate"),
        F.round(100 * (F.sum("urgent") - F.sum("relaxed")) / n, 1).alias("latency_increase_pct"),
        (F.sum("lost") > 0).alias("data_loss_detected"),
        (F.sum("pending") * 5).alias("streaming_lag"),
        (F.sum("escalated") > 0).alias("escalation_raised"),
    )


@REG.query(
    "rollback_conditions",
    f"""WITH m AS ({_METRICS_SQL}),
    r AS (SELECT *, CASE WHEN dvt_pass_rate < 0 OR dvt_pass_rate > 1 THEN 'dvt_pass_rate must be between 0.0 and 1.0'
       WHEN latency_increase_pct < 0 THEN 'latency_increase_pct must be >= 0.0' WHEN streaming_lag < 0 THEN 'streaming_lag must be >= 0' END AS reject_reason,
       dvt_pass_rate < 0.99 OR latency_increase_pct > 20 OR data_loss_detected OR streaming_lag > 1000 OR escalation_raised AS hit FROM m)
    SELECT wave_id, coalesce(reject_reason, '') AS reject_reason,
      CASE WHEN reject_reason IS NOT NULL THEN 'rejected' WHEN hit THEN 'rollback' ELSE 'go on' END AS verdict,
      CASE WHEN reject_reason IS NOT NULL OR NOT hit THEN '' ELSE 'Triggered conditions: ' || concat_ws(', ',
        CASE WHEN dvt_pass_rate < 0.99 THEN 'DVT pass rate' END, CASE WHEN latency_increase_pct > 20 THEN 'Latency increase' END,
        CASE WHEN data_loss_detected THEN 'Data loss' END, CASE WHEN streaming_lag > 1000 THEN 'Streaming lag' END,
        CASE WHEN escalation_raised THEN 'Escalation raised' END) END AS reason,
      CASE WHEN reject_reason IS NOT NULL THEN '' ELSE
        'Pass rate ' || printf('%.4f', dvt_pass_rate) || CASE WHEN dvt_pass_rate < 0.99 THEN ' (below' ELSE ' (at or above' END || ' 0.99 threshold)'
        || '; Latency increase ' || printf('%.1f', latency_increase_pct) || CASE WHEN latency_increase_pct > 20 THEN '% (exceeds' ELSE '% (within' END || ' 20% threshold)'
        || CASE WHEN data_loss_detected THEN '; Data loss detected' ELSE '; No data loss detected' END
        || '; Streaming lag ' || streaming_lag || CASE WHEN streaming_lag > 1000 THEN ' (exceeds' ELSE ' (within' END || ' 1000 threshold)'
        || CASE WHEN escalation_raised THEN '; Escalation raised' ELSE '; No escalation raised' END END AS details
    FROM r""",
)
def _rollback(t: Tables):
    out = gates.rollback_conditions(wave_metrics(t))
    verdict = (
        F.when(col("reject_reason").isNotNull(), "rejected").when(col("should_rollback"), "rollback").otherwise("go on")
    )
    return out.select(
        "wave_id",
        F.coalesce("reject_reason", lit("")).alias("reject_reason"),
        verdict.alias("verdict"),
        F.coalesce(gates.rollback_reason(col("conditions")), lit("")).alias("reason"),
        F.coalesce(F.array_join(F.transform("conditions", lambda c: c["details"]), "; "), lit("")).alias("details"),
    )


@REG.query(
    "enforce_gate",
    f"""WITH m AS ({_METRICS_SQL}),
    g AS (SELECT wave_id, dvt_pass_rate >= 0.98 AS a, abs(latency_increase_pct) <= 5 AS b, NOT data_loss_detected AS c,
                 streaming_lag <= 1000 AS d, NOT escalation_raised AS e FROM m)
    SELECT wave_id, concat_ws(',', CASE WHEN a THEN 'dvt_passed' END, CASE WHEN b THEN 'latency_ok' END, CASE WHEN c THEN 'no_data_loss' END,
             CASE WHEN d THEN 'streaming_stable' END, CASE WHEN e THEN 'kpis_reconciled' END) AS criteria_met,
           concat_ws(',', CASE WHEN NOT a THEN 'dvt_passed' END, CASE WHEN NOT b THEN 'latency_ok' END, CASE WHEN NOT c THEN 'no_data_loss' END,
             CASE WHEN NOT d THEN 'streaming_stable' END, 'dashboards_verified', CASE WHEN NOT e THEN 'kpis_reconciled' END) AS criteria_failed,
           false AS passed FROM g""",
)
def _gate(t: Tables):
    # dashboards_verified is never reported, so it counts as failed
    criteria = F.create_map(
        lit("dvt_passed"), col("dvt_pass_rate") >= 0.98,
        lit("latency_ok"), F.abs("latency_increase_pct") <= 5,
        lit("no_data_loss"), ~col("data_loss_detected"),
        lit("streaming_stable"), col("streaming_lag") <= 1000,
        lit("kpis_reconciled"), ~col("escalation_raised"),
    )
    out = gates.enforce_gate(wave_metrics(t).select("wave_id", criteria.alias("criteria")))
    return out.select(
        "wave_id", F.array_join("criteria_met", ",").alias("criteria_met"),
        F.array_join("criteria_failed", ",").alias("criteria_failed"), "passed",
    )


@REG.query(
    "merge_gate_results",
    """WITH r AS (SELECT o_custkey AS wave_id, o_orderpriority AS criterion, o_orderstatus <> 'P' AS met,
                         row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
       SELECT wave_id, bool_and(met) AS passed, count(*) AS criteria, count(*) FILTER (WHERE met) AS criteria_met,
              CASE WHEN bool_and(met) THEN 'CUTOVER_READY' ELSE 'REVERSE_SHADOW_RUNNING' END AS status
       FROM r WHERE rn = 1 GROUP BY 1""",
)
def _merge(t: Tables):
    results = t.orders.select(
        col("o_custkey").alias("wave_id"), col("o_orderpriority").alias("criterion"),
        (col("o_orderstatus") != "P").alias("met"), "o_orderdate", "o_orderkey",
    )
    merged = gates.merge_gate_results(results, order=("o_orderdate", "o_orderkey"))
    return merged.withColumn("status", gates.status_after_gate(lit("REVERSE_SHADOW_RUNNING"), col("passed")))


# -- transitions: the orders of a customer are its mode history, the events of a user a status history ---

_MODE_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN 'OLD_ONLY' WHEN '2-HIGH' THEN 'SHADOW'
    WHEN '3-MEDIUM' THEN 'REVERSE_SHADOW' WHEN '4-NOT SPECIFIED' THEN 'NEW_ONLY' ELSE 'OLD_ONLY' END"""
_TARGET_SQL = "CASE o_orderstatus WHEN 'F' THEN 'OLD_ONLY' WHEN 'O' THEN 'SHADOW' ELSE 'NEW_ONLY' END"
_LEGAL_MODES = """(('OLD_ONLY', 'SHADOW'), ('SHADOW', 'REVERSE_SHADOW'), ('SHADOW', 'OLD_ONLY'), ('REVERSE_SHADOW', 'NEW_ONLY'),
    ('REVERSE_SHADOW', 'OLD_ONLY'), ('NEW_ONLY', 'OLD_ONLY'))"""


def run_mode():
    p = col("o_orderpriority")
    return (
        F.when(p == "1-URGENT", "OLD_ONLY").when(p == "2-HIGH", "SHADOW").when(p == "3-MEDIUM", "REVERSE_SHADOW")
        .when(p == "4-NOT SPECIFIED", "NEW_ONLY").otherwise("OLD_ONLY")
    )


@REG.query(
    "legal_transition",
    f"""SELECT o_orderkey, {_MODE_SQL} AS current_mode, {_TARGET_SQL} AS target_mode,
        ({_MODE_SQL}, {_TARGET_SQL}) IN {_LEGAL_MODES} AS legal,
        CASE {_MODE_SQL} WHEN 'OLD_ONLY' THEN 'SHADOW' WHEN 'SHADOW' THEN 'REVERSE_SHADOW,OLD_ONLY'
             WHEN 'REVERSE_SHADOW' THEN 'NEW_ONLY,OLD_ONLY' ELSE 'OLD_ONLY' END AS options FROM orders""",
)
def _legal(t: Tables):
    target = F.when(col("o_orderstatus") == "F", "OLD_ONLY").when(col("o_orderstatus") == "O", "SHADOW").otherwise("NEW_ONLY")
    modes = t.orders.select("o_orderkey", run_mode().alias("current_mode"), target.alias("target_mode"))
    return modes.select(
        "*",
        gates.legal_transition(col("current_mode"), col("target_mode"), gates.RUN_MODE_STEPS).alias("legal"),
        F.array_join(gates.next_states(col("current_mode"), gates.RUN_MODE_STEPS), ",").alias("options"),
    )


@REG.query(
    "transition_audit",
    f"""WITH h AS (SELECT o_custkey, o_orderkey, {_MODE_SQL} AS mode,
          lag({_MODE_SQL}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders)
        SELECT o_custkey, o_orderkey, mode, coalesce(previous, '') AS previous,
               CASE WHEN previous IS NULL THEN 'first' WHEN (previous, mode) IN {_LEGAL_MODES} THEN 'legal' ELSE 'illegal' END AS verdict FROM h""",
)
def _audit(t: Tables):
    history = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", run_mode().alias("mode"))
    bucket = F.struct("o_orderdate", F.floor(col("o_orderkey") / 1_000_000).alias("part"))
    audited = gates.transition_audit(
        history, "o_custkey", ["o_orderdate", "o_orderkey"], "mode", gates.RUN_MODE_STEPS, bucket
    )
    return audited.select(
        "o_custkey", "o_orderkey", "mode", F.coalesce("previous", lit("")).alias("previous"),
        F.when(col("legal").isNull(), "first").when(col("legal"), "legal").otherwise("illegal").alias("verdict"),
    )


_STATUS_SQL = """CASE event_type WHEN 'view' THEN 'SHADOW_RUNNING' WHEN 'click' THEN 'REVERSE_SHADOW_RUNNING'
    WHEN 'signup' THEN 'CUTOVER_READY' WHEN 'purchase' THEN 'CUTTING_OVER' ELSE 'ROLLED_BACK' END"""
_LEGAL_STATUS = """(('PLANNED', 'SHADOW_RUNNING'), ('SHADOW_RUNNING', 'REVERSE_SHADOW_RUNNING'), ('SHADOW_RUNNING', 'ROLLED_BACK'),
    ('REVERSE_SHADOW_RUNNING', 'CUTOVER_READY'), ('REVERSE_SHADOW_RUNNING', 'ROLLED_BACK'), ('CUTOVER_READY', 'CUTTING_OVER'),
    ('CUTOVER_READY', 'ROLLED_BACK'), ('CUTTING_OVER', 'COMPLETED'), ('CUTTING_OVER', 'ROLLED_BACK'))"""


@REG.query(
    "wave_status_rules",
    f"""WITH h AS (SELECT user_id, {_STATUS_SQL} AS status, lag({_STATUS_SQL}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
        SELECT previous, status, (previous, status) IN {_LEGAL_STATUS} AS legal, count(*) AS steps FROM h WHERE previous IS NOT NULL GROUP BY 1, 2, 3""",
)
def _wave_status(t: Tables):
    e = col("event_type")
    status = (
        F.when(e == "view", "SHADOW_RUNNING").when(e == "click", "REVERSE_SHADOW_RUNNING").when(e == "signup", "CUTOVER_READY")
        .when(e == "purchase", "CUTTING_OVER").otherwise("ROLLED_BACK")
    )
    history = t.events.select("user_id", "event_id", "ts", status.alias("status"))
    audited = gates.transition_audit(
        history, "user_id", ["ts", "event_id"], "status", gates.WAVE_STATUS_STEPS, F.date_trunc("minute", "ts")
    )
    return audited.filter("previous IS NOT NULL").groupBy("previous", "status", "legal").agg(F.count("*").alias("steps"))


# -- small rules ---------------------------------------------------------------------------------------------


@REG.query(
    "transfer_progress",
    """WITH j AS (SELECT l_orderkey, sum(CASE WHEN l_tax > 0.05 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS total,
                         sum(CASE WHEN l_tax > 0.05 AND l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS done
                  FROM lineitem GROUP BY 1)
       SELECT l_orderkey, CASE WHEN total = 0 THEN 100.0 ELSE done / total * 100 END AS progress FROM j""",
)
def _progress(t: Tables):
    taxed, size = col("l_tax") > 0.05, col("l_quantity").cast("bigint")
    jobs = t.lineitem.groupBy("l_orderkey").agg(
        F.sum(F.when(taxed, size).otherwise(0)).alias("total"),
        F.sum(F.when(taxed & (col("l_linestatus") == "F"), size).otherwise(0)).alias("done"),
    )
    return jobs.select("l_orderkey", gates.transfer_progress(col("done"), col("total")).alias("progress"))


REG.add("query_byte_estimate",
        lambda t: t.documents.select("doc_id", gates.query_byte_estimate(col("text")).alias("bytes")),
        "SELECT doc_id, CAST(octet_length(encode(text)) * 10 AS BIGINT) AS bytes FROM documents")
REG.add("cutover_gate",
        lambda t: t.events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
        .agg(F.sum(F.when(col("event_type") == "error", col("value").cast("bigint")).otherwise(0)).alias("lag"))
        .withColumn("status", gates.cutover_gate(col("lag"))),
        """SELECT date_trunc('day', ts) AS day, CAST(sum(CASE WHEN event_type = 'error' THEN CAST(trunc(value) AS BIGINT) ELSE 0 END) AS BIGINT) AS lag,
           CASE WHEN sum(CASE WHEN event_type = 'error' THEN CAST(trunc(value) AS BIGINT) ELSE 0 END) <= 1000 THEN 'verified' ELSE 'failed' END AS status
           FROM events GROUP BY 1""")  # fmt: skip
