"""Lookups, joins, aggregates, windows and sorts bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.functions import aggregates as agg
from lakeproof.functions import windows as w
from lakeproof.operators import lookups
from lakeproof.plans.altered import ORDERS_TARGET_SQL, orders_target
from lakeproof.plans.registry import Registry, Tables

REG = Registry()
col, lit = F.col, F.lit

# -- permissions: every event is a policy record --------------------------------------------------------

_POLICY_SQL = """SELECT event_id, upper(coalesce(CASE event_type WHEN 'view' THEN 'select' WHEN 'purchase' THEN 'Insert' WHEN 'click' THEN 'ALL'
    WHEN 'error' THEN 'drop' END, '')) AS permission, 'table-' || event_id AS resource,
    CASE WHEN value > 100 THEN 'unknown' ELSE 'user-' || user_id END AS principal FROM events"""
_ROLE_SQL = """CASE permission WHEN 'SELECT' THEN 'roles/bigquery.dataViewer' WHEN 'INSERT' THEN 'roles/bigquery.dataEditor'
    WHEN 'UPDATE' THEN 'roles/bigquery.dataEditor' WHEN 'DELETE' THEN 'roles/bigquery.dataEditor' WHEN 'ALL' THEN 'roles/bigquery.dataOwner'
    ELSE 'roles/bigquery.dataViewer' END"""


def policies(t: Tables) -> DataFrame:
    e = col("event_type")
    return t.events.select(
        F.when(e == "view", "select").when(e == "purchase", "Insert").when(e == "click", "ALL").when(e == "error", "drop").alias("permission"),
        F.concat(lit("table-"), col("event_id").cast("string")).alias("resource"),
        F.when(~(col("value") > 100), F.concat(lit("user-"), col("user_id").cast("string"))).alias("principal"),
    )


REG.add("map_permissions", lambda t: lookups.map_permissions(policies(t)),
        f"""SELECT permission, resource, principal, {_ROLE_SQL} AS role,
            permission NOT IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE', 'ALL') AS is_default FROM ({_POLICY_SQL})""")  # fmt: skip
REG.add("permission_lookup",
        lambda t: lookups.permission_lookup(policies(t).select(F.upper("permission").alias("permission")), lookups.permission_table(t.events))
        .groupBy("role", "is_default").agg(F.count("*").alias("policies")),
        f"""SELECT {_ROLE_SQL} AS role, permission NOT IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE', 'ALL') AS is_default,
            count(*) AS policies FROM ({_POLICY_SQL}) GROUP BY 1, 2""")  # fmt: skip

# -- text lookup and query outcomes -----------------------------------------------------------------------

REG.add("text_lookup",
        lambda t: lookups.text_lookup(t.documents.select("doc_id"), t.pages.select(col("page_id").alias("doc_id"), "html"), "doc_id", "html")
        .select("doc_id", F.length("html").cast("bigint").alias("size")),
        "SELECT doc_id, CAST(length(coalesce(html, '')) AS BIGINT) AS size FROM documents LEFT JOIN pages ON doc_id = page_id")

# -- keys and case ------------------------------------------------------------------------------------------

REG.add("key_compare",
        lambda t: lookups.key_compare(t.orders, orders_target(t.orders), ["o_custkey", "o_orderstatus"]),
        f"""WITH tgt AS ({ORDERS_TARGET_SQL}),
        s AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM tgt GROUP BY 1, 2)
        SELECT coalesce(s.o_custkey, g.o_custkey) AS o_custkey, coalesce(s.o_orderstatus, g.o_orderstatus) AS o_orderstatus,
               coalesce(s.n, 0) AS source_rows, coalesce(g.n, 0) AS target_rows,
               CASE WHEN g.n IS NULL THEN 'source_only' WHEN s.n IS NULL THEN 'target_only' ELSE 'both' END AS presence
        FROM s FULL OUTER JOIN g ON s.o_custkey = g.o_custkey AND s.o_orderstatus = g.o_orderstatus""")  # fmt: skip


@REG.query(
    "case_insensitive_match",
    """WITH k AS (SELECT DISTINCT lower(p_type) AS kind FROM part)
       SELECT k.kind, p.p_type = upper(p.p_type) AS upper_case, count(*) AS parts,
              count(*) FILTER (WHERE upper(split_part(p_name, ' ', 1)) = upper(p_type)) AS named_alike
       FROM part p JOIN k ON upper(p.p_type) = upper(k.kind) GROUP BY 1, 2""",
)
def _case(t: Tables):
    part = t.part
    kinds = part.select(F.lower("p_type").alias("kind")).distinct()
    joined = lookups.case_insensitive_join(part, kinds, "p_type", "kind")
    alike = lookups.case_insensitive_equal(F.split("p_name", " ")[0], col("p_type"))
    return joined.groupBy("kind", (col("p_type") == F.upper("p_type")).alias("upper_case")).agg(
        F.count("*").alias("parts"), F.count_if(alike).alias("named_alike")
    )


# -- unnest and lateral ---------------------------------------------------------------------------------------

REG.add("unnest_join",
        lambda t: lookups.unnest_join(t.documents, F.split("text", " "), "word").groupBy("lang", F.lower("word").alias("word")).agg(F.count("*").alias("n")),
        """SELECT lang, lower(word) AS word, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents)
           GROUP BY 1, 2""")  # fmt: skip


@REG.query(
    "lateral_join",
    """SELECT c_custkey, s.orders, s.best FROM customer, LATERAL (
         SELECT count(*) AS orders, max(o_totalprice) AS best FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P') s""",
)
def _lateral(t: Tables):
    # decorrelated by the optimizer into an aggregate per customer and an outer join
    sub = (
        t.orders.filter((col("o_custkey") == col("c_custkey").outer()) & (col("o_orderstatus") != "P"))
        .select(F.count("*").alias("orders"), F.max("o_totalprice").alias("best"))
    )
    return t.customer.lateralJoin(sub).select("c_custkey", "orders", "best")


# -- aggregates -----------------------------------------------------------------------------------------------

REG.add("distinct_agg",
        lambda t: t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count_distinct("o_custkey").alias("buyers"), F.count_distinct("o_orderpriority").alias("priorities")),
        "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_custkey) AS buyers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1")


@REG.query(
    "approx_distinct_agg",
    "SELECT o_orderpriority, count(DISTINCT o_custkey) AS buyers, true AS within_bound FROM orders GROUP BY 1",
)
def _approx_distinct(t: Tables):
    # the estimate is shown to be within four standard errors of its exact twin
    orders = t.orders.groupBy("o_orderpriority")
    out = orders.agg(F.count_distinct("o_custkey").alias("buyers")).join(
        orders.agg(agg.approx_distinct(col("o_custkey")).alias("estimate")), "o_orderpriority"
    )
    bound = F.abs(col("estimate") - col("buyers")) <= 0.092 * col("buyers")
    return out.select("o_orderpriority", "buyers", bound.alias("within_bound"))


@REG.query(
    "approx_percentile_agg",
    "SELECT user_id, count(*) AS events, true AS within_bound FROM events GROUP BY 1",
)
def _approx_percentile(t: Tables):
    # the estimate must stand at a rank within the sketch's error of the percentile's
    estimates = t.events.groupBy("user_id").agg(F.count("*").alias("events"), agg.approx_percentile(col("value"), 0.95).alias("p95"))
    ranks = t.events.join(estimates, "user_id").groupBy("user_id", "events").agg(
        F.count_if(col("value") <= col("p95")).alias("upto"), F.count_if(col("value") < col("p95")).alias("below")
    )
    slack = col("events") / 10_000 + 1
    bound = (col("upto") >= 0.95 * col("events") - slack) & (col("below") <= 0.95 * col("events") + slack)
    return ranks.select("user_id", "events", bound.alias("within_bound"))


REG.add("array_agg_distinct",
        lambda t: t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
        .select("o_custkey", F.array_join("p", ",").alias("priorities"), F.size("p").cast("bigint").alias("n")),
        """SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities,
           count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1""")  # fmt: skip

# -- windows and sorts ------------------------------------------------------------------------------------------


@REG.query(
    "window_ranks",
    """SELECT o_orderkey, row_number() OVER o AS row_number, cume_dist() OVER d AS cume_dist, CAST(ntile(7) OVER o AS BIGINT) AS ntile,
              coalesce(nth_value(o_orderkey, 3) OVER o, -1) AS third
       FROM orders WINDOW o AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey), d AS (PARTITION BY o_orderstatus ORDER BY o_orderdate)""",
)
def _ranks(t: Tables):
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    bucket = F.struct("o_orderdate", F.floor(col("o_orderkey") / 1_000_000).alias("part"))
    by_row = w.ranked(orders, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], bucket)
    rows = w.with_nth_value(by_row, ["o_orderstatus"], "o_orderkey", 3, "third")
    # days with several orders are peers: their share of rows up to and including the day
    by_day = orders.groupBy("o_orderstatus", "o_orderdate").agg(F.count("*").alias("n"))
    day = w.Window.partitionBy("o_orderstatus").orderBy("o_orderdate")
    ends = by_day.select(
        "o_orderstatus", "o_orderdate",
        (F.sum("n").over(day) / F.sum("n").over(w.Window.partitionBy("o_orderstatus"))).alias("cume_dist"),
    )
    return rows.join(ends, ["o_orderstatus", "o_orderdate"]).select(
        "o_orderkey", w.row_number().alias("row_number"), "cume_dist", w.ntile(7).cast("bigint").alias("ntile"),
        F.coalesce("third", lit(-1)).alias("third"),
    )


@REG.query(
    "window_ranks_sampled",
    """SELECT o_orderkey, row_number() OVER o AS row_number, cume_dist() OVER o AS cume_dist, CAST(ntile(7) OVER o AS BIGINT) AS ntile
       FROM orders WINDOW o AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)""",
)
def _sampled_ranks(t: Tables):
    # no bucket is named, and every status is split
    rows = w.ranked(t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), ["o_orderstatus"], ["o_orderdate", "o_orderkey"], hot_rows=100)
    return rows.select("o_orderkey", w.row_number().alias("row_number"), w.cume_dist().alias("cume_dist"), w.ntile(7).cast("bigint").alias("ntile"))


REG.add("ordered_limit",
        lambda t: lookups.ordered_limit(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 1000),
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
REG.add("sorted_distinct",
        lambda t: lookups.sorted_distinct(t.part, "p_name"),
        "SELECT DISTINCT p_name FROM part ORDER BY 1")
