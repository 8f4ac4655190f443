"""The four report queries; relative dates are the parameter ``as_of``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeproof.functions import aggregates as agg
from lakeproof.functions import collections as coll
from lakeproof.functions import scalars, temporal, text
from lakeproof.plans.registry import Registry, Tables

REG = Registry()
col, lit = F.col, F.lit


def exact_sum(c):
    return F.sum(c.cast("decimal(28,6)"))


# -- daily revenue ----------------------------------------------------------------------------------------


def daily_revenue(t: Tables, as_of: str, days: int):
    """Orders are summed per customer and day before the join, so a customer with very many orders is one row a day in
    it. A customer has one nation and segment and an order one customer, so customers need no distinct count after it
    and orders none but the first."""
    start = temporal.date_add("day", -days, lit(as_of).cast("timestamp_ntz"))
    recent = t.orders.filter((col("o_orderdate") >= start) & (col("o_orderstatus") == "F") & (col("o_totalprice") > 0))
    bought = recent.groupBy("o_custkey", temporal.date_trunc("day", col("o_orderdate")).alias("report_date")).agg(
        F.count_distinct("o_orderkey").alias("orders"),
        exact_sum(col("o_totalprice")).alias("revenue"),
        F.count("o_totalprice").alias("rows"),
        F.collect_set("o_orderpriority").alias("methods"),
    )
    sales = bought.join(t.customer, col("o_custkey") == col("c_custkey")).join(t.nation, col("c_nationkey") == col("n_nationkey"))
    return (
        sales.groupBy("report_date", "n_name", "c_mktsegment")
        .agg(
            F.sum("orders").alias("total_orders"),
            F.count("*").alias("unique_customers"),
            F.sum("revenue").cast("double").alias("total_revenue"),
            F.sum("rows").alias("rows"),
            # sets of the few priorities there are
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("methods")))).alias("payment_methods"),
        )
        .select(
            "report_date", "n_name", "c_mktsegment", "total_orders", "unique_customers", "total_revenue",
            (col("total_revenue") / col("rows")).alias("avg_order_value"),
            F.array_join(col("payment_methods"), ",").alias("payment_methods"),
            F.cardinality(col("payment_methods")).cast("bigint").alias("payment_method_count"),
            temporal.date_format(lit(as_of).cast("timestamp_ntz"), "%Y-%m-%d %H:%i:%s").alias("generated_at"),
        )
        .orderBy(F.desc("total_revenue"))
    )


@REG.query(
    "daily_revenue",
    """SELECT date_trunc('day', o_orderdate) AS report_date, n_name, c_mktsegment, count(DISTINCT o_orderkey) AS total_orders,
       count(DISTINCT o_custkey) AS unique_customers, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS total_revenue,
       CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) / count(o_totalprice) AS avg_order_value,
       string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS payment_methods,
       count(DISTINCT o_orderpriority) AS payment_method_count, '2001-08-02 00:00:00' AS generated_at
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 2500 DAY AND o_orderstatus = 'F' AND o_totalprice > 0 GROUP BY 1, 2, 3""",
)
def _daily(t: Tables):
    return daily_revenue(t, "2001-08-02 00:00:00", 2500)


# -- user activity ------------------------------------------------------------------------------------------


def sessions(t: Tables, as_of: str, days: int):
    start = temporal.date_add("day", -days, lit(as_of).cast("timestamp_ntz"))
    hour = temporal.date_trunc("hour", col("ts"))
    domain = coll.element_at(text.split(col("props"), ":"), 1)
    return (
        t.events.filter(col("ts") >= start)
        .groupBy("user_id", F.date_trunc("day", "ts").alias("session_id"), hour.alias("session_hour"), domain.alias("domain"))
        .agg(
            F.count("event_type").alias("event_count"),
            agg.arbitrary(col("event_type")).alias("primary_device"),
            temporal.from_unixtime(F.min(temporal.to_unixtime(col("ts")))).alias("session_start"),
            temporal.from_unixtime(F.max(temporal.to_unixtime(col("ts")))).alias("session_end"),
        )
    )


def user_activity(t: Tables, as_of: str, days: int):
    length = temporal.date_diff("second", col("session_start"), col("session_end"))
    return (
        sessions(t, as_of, days).groupBy("session_hour")
        .agg(
            F.count_distinct("user_id").alias("active_users"),
            F.count("session_id").alias("total_sessions"),
            F.avg("event_count").alias("avg_events_per_session"),
            F.avg(length).alias("avg_session_duration_sec"),
            agg.approx_percentile(col("event_count"), 0.95).alias("p95_events"),
        )
        .select(F.date_format("session_hour", "yyyy-MM-dd HH:mm:ss").alias("hour_str"), "active_users", "total_sessions",
                "avg_events_per_session", "avg_session_duration_sec", "p95_events")
        .orderBy(F.desc("hour_str"))
    )


@REG.query(
    "user_activity",
    """WITH s AS (SELECT user_id, date_trunc('day', ts) AS session_id, date_trunc('hour', ts) AS session_hour, count(event_type) AS event_count,
                  date_sub('second', min(ts), max(ts)) AS secs
           FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 31 DAY GROUP BY 1, 2, 3, split_part(props, ':', 1)),
       r AS (SELECT *, row_number() OVER (PARTITION BY session_hour ORDER BY event_count) AS rn, count(*) OVER (PARTITION BY session_hour) AS n FROM s)
       SELECT strftime(session_hour, '%Y-%m-%d %H:%M:%S') AS hour_str, count(DISTINCT user_id) AS active_users, count(session_id) AS total_sessions,
              avg(event_count) AS avg_events_per_session, avg(secs) AS avg_session_duration_sec,
              true AS p95_ok
       FROM r GROUP BY session_hour""",
)
def _activity(t: Tables):
    report = user_activity(t, "2024-01-31 00:00:00", 31)
    # the estimate must stand at a rank within the sketch's error of the percentile's
    hour = F.date_format("session_hour", "yyyy-MM-dd HH:mm:ss")
    counts = sessions(t, "2024-01-31 00:00:00", 31).select(hour.alias("hour_str"), "event_count")
    ranks = counts.join(report.select("hour_str", "p95_events"), "hour_str").groupBy("hour_str").agg(
        F.count("*").alias("n"), F.count_if(col("event_count") <= col("p95_events")).alias("upto"),
        F.count_if(col("event_count") < col("p95_events")).alias("below"),
    )
    slack = col("n") / 10_000 + 1
    bound = (col("upto") >= 0.95 * col("n") - slack) & (col("below") <= 0.95 * col("n") + slack)
    return report.drop("p95_events").join(ranks.select("hour_str", bound.alias("p95_ok")), "hour_str")


# -- campaign performance -------------------------------------------------------------------------------------


def campaign_performance(t: Tables, as_of: str, months: int, least_impressions: int):
    start = temporal.date_add("month", -months, lit(as_of).cast("timestamp_ntz"))
    spend = exact_sum(F.when(col("event_type") != "purchase", col("value")).otherwise(0.0))
    revenue = exact_sum(F.when(col("event_type") == "purchase", col("value")).otherwise(0.0))
    weekly = (
        t.events.filter(col("ts") >= start)
        .groupBy(F.pmod("user_id", lit(5)).alias("campaign"), temporal.date_trunc("week", col("ts")).alias("week_start"))
        .agg(
            F.count("*").alias("total_impressions"),
            agg.count_if(col("event_type") == "click").alias("total_clicks"),
            spend.cast("double").alias("total_spend"),
            agg.count_if(col("event_type") == "purchase").alias("total_conversions"),
            revenue.cast("double").alias("attributed_revenue"),
            agg.approx_distinct(col("user_id")).alias("unique_reach"),
        )
    )
    ratio = lambda a, b: a.cast("double") / F.nullif(b, lit(0)).cast("double")
    return (
        weekly.filter(col("total_impressions") > least_impressions)
        .select(
            "campaign", "week_start", "total_impressions", "total_clicks",
            F.round(ratio(col("total_clicks"), col("total_impressions")) * 100, 2).alias("ctr_pct"),
            "total_spend", "total_conversions",
            F.round(ratio(col("total_spend"), col("total_conversions")), 2).alias("cost_per_conversion"),
            "attributed_revenue",
            F.round(ratio(col("attributed_revenue"), col("total_spend")), 2).alias("roas"),
            "unique_reach",
        )
        .orderBy(F.desc("attributed_revenue"))
    )


@REG.query(
    "campaign_performance",
    """WITH w AS (SELECT user_id % 5 AS campaign, date_trunc('week', ts) AS week_start, count(*) AS total_impressions,
         count(*) FILTER (WHERE event_type = 'click') AS total_clicks,
         CAST(sum(CASE WHEN event_type <> 'purchase' THEN CAST(value AS DECIMAL(28,6)) ELSE 0 END) AS DOUBLE) AS total_spend,
         count(*) FILTER (WHERE event_type = 'purchase') AS total_conversions,
         CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(28,6)) ELSE 0 END) AS DOUBLE) AS attributed_revenue
       FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 3 MONTH GROUP BY 1, 2)
       SELECT campaign, week_start, total_impressions, total_clicks,
         round(CAST(total_clicks AS DOUBLE) / NULLIF(total_impressions, 0) * 100, 2) AS ctr_pct, total_spend, total_conversions,
         round(total_spend / NULLIF(CAST(total_conversions AS DOUBLE), 0), 2) AS cost_per_conversion, attributed_revenue,
         round(attributed_revenue / NULLIF(total_spend, 0), 2) AS roas, true AS reach_ok
       FROM w WHERE total_impressions > 100""",
)
def _campaign(t: Tables):
    report = campaign_performance(t, "2024-01-31 00:00:00", 3, 100)
    # the estimate is shown to be within four standard errors of its exact twin
    start = temporal.date_add("month", -3, lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    recent = t.events.filter(col("ts") >= start).groupBy(F.pmod("user_id", lit(5)).alias("campaign"), temporal.date_trunc("week", col("ts")).alias("week_start"))
    exact = recent.agg(F.count_distinct("user_id").alias("users"))
    close = F.abs(col("unique_reach") - col("users")) <= 0.092 * col("users")
    return report.join(exact, ["campaign", "week_start"]).withColumn("reach_ok", close).drop("unique_reach", "users")


# -- inventory snapshot -----------------------------------------------------------------------------------------


def inventory_snapshot(t: Tables, as_of: str, rows: int = 1000):
    stock = t.lineitem.groupBy("l_partkey").agg(
        F.sum(col("l_quantity").cast("bigint")).cast("string").alias("quantity"),
        F.max("l_shipdate").alias("last_received"),
    )
    tags = text.split(col("p_name"), " ")
    quantity = scalars.try_cast(col("quantity"), "bigint")
    reorder_point = col("p_size") * 15
    status = F.when(quantity < reorder_point, "REORDER").when(quantity < reorder_point * 2, "LOW").otherwise("OK")
    value = scalars.cast_double(col("quantity")) * scalars.cast_double(col("p_retailprice"))
    return (
        t.part.join(stock, col("p_partkey") == col("l_partkey"))
        .select(
            "p_brand", "p_partkey", "p_name",
            F.coalesce(quantity, lit(0)).alias("quantity_on_hand"),
            scalars.cast_double(col("p_retailprice")).alias("unit_cost"),
            F.round(value, 2).alias("inventory_value"),
            status.alias("stock_status"),
            temporal.date_format(col("last_received"), "%Y-%m-%d").alias("last_updated_date"),
            F.array_contains(tags, "bolt").alias("is_perishable"),
            F.array_join(tags, " | ").alias("tag_list"),
            scalars.if_(quantity == 0, "OUT_OF_STOCK", "IN_STOCK").alias("availability"),
            temporal.date_diff("day", col("last_received"), lit(as_of).cast("timestamp_ntz")).alias("days_since_receipt"),
        )
        .orderBy(F.desc("inventory_value"), "p_partkey")
        .limit(rows)
    )


@REG.query(
    "inventory_snapshot",
    """WITH s AS (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS quantity, max(l_shipdate) AS last_received FROM lineitem GROUP BY 1)
       SELECT p_brand, p_partkey, p_name, quantity AS quantity_on_hand, p_retailprice AS unit_cost,
         round(CAST(quantity AS DOUBLE) * p_retailprice, 2) AS inventory_value,
         CASE WHEN quantity < p_size * 15 THEN 'REORDER' WHEN quantity < p_size * 30 THEN 'LOW' ELSE 'OK' END AS stock_status,
         strftime(last_received, '%Y-%m-%d') AS last_updated_date, list_contains(string_split(p_name, ' '), 'bolt') AS is_perishable,
         replace(p_name, ' ', ' | ') AS tag_list, CASE WHEN quantity = 0 THEN 'OUT_OF_STOCK' ELSE 'IN_STOCK' END AS availability,
         date_sub('day', last_received, TIMESTAMP '2002-01-01') AS days_since_receipt
       FROM part JOIN s ON p_partkey = l_partkey ORDER BY inventory_value DESC, p_partkey LIMIT 1000""",
)
def _snapshot(t: Tables):
    return inventory_snapshot(t, "2002-01-01 00:00:00")
