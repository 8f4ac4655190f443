"""Inventory, tier, wave and log queries.

The inventory has one row per customer: its orders are the contents, finished orders the uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.operators import inventory as inv
from lakeproof.operators import waves
from lakeproof.plans.registry import Registry, Tables

REG = Registry()
AS_OF = "2001-08-02"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def customer_inventory(t: Tables) -> DataFrame:
    """Orders are summed per customer before the join, so a customer with most orders is one row in it."""
    used = (
        t.orders.groupBy("o_custkey")
        .agg(
            (F.sum(F.col("o_totalprice").cast("decimal(18,2)")) * 400000).cast("bigint").alias("size_bytes"),
            F.count("*").alias("row_count"),
            F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("last_queried"),
            F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("has_maps"),
        )
    )
    return t.customer.join(used, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.concat(F.lit("inventory-"), F.col("c_nationkey").cast("string")).alias("inventory_id"),
        F.col("c_name").alias("table_name"),
        F.col("c_mktsegment").alias("database"),
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.col("last_queried").cast("timestamp").alias("last_queried"),
        (F.col("c_acctbal") > 5000).alias("partitioned"),
        F.lit("PARQUET").alias("format"),
        F.coalesce("has_maps", F.lit(False)).alias("has_maps"),
    )


INVENTORY_SQL = """
SELECT 'inventory-' || c_nationkey AS inventory_id, c_name AS table_name, c_mktsegment AS database,
       CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) * 400000, 0) AS BIGINT) AS size_bytes,
       count(o_orderkey) AS row_count, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS last_queried,
       c_acctbal > 5000 AS partitioned, 'PARQUET' AS format,
       coalesce(bool_or(o_orderpriority = '1-URGENT'), false) AS has_maps
FROM customer LEFT JOIN orders ON c_custkey = o_custkey
GROUP BY c_custkey, c_name, c_mktsegment, c_nationkey, c_acctbal
"""
DAYS_SQL = f"CAST(floor((epoch_us(TIMESTAMP '{AS_OF} 00:00:00') - epoch_us(last_queried)) / 86400000000) AS INTEGER)"
CLASSIFIED_SQL = f"""
SELECT *, CASE WHEN last_queried IS NULL OR days >= 90 THEN 'TIER_3' WHEN size_bytes < 1099511627776 THEN 'TIER_1' ELSE 'TIER_2' END AS tier,
  CASE WHEN last_queried IS NULL THEN 'Table has never been queried'
       WHEN days >= 90 THEN 'Not queried in ' || days || ' days (>= 90)'
       WHEN size_bytes < 1099511627776 THEN 'Queried ' || days || ' days ago, size < 1 TB'
       ELSE 'Queried ' || days || ' days ago, size >= 1 TB' END AS reason
FROM (SELECT *, {DAYS_SQL} AS days FROM ({INVENTORY_SQL}))
"""


def classified(t: Tables) -> DataFrame:
    return inv.classify_tiers(customer_inventory(t), as_of())


@REG.query(
    "classify_tiers",
    f"SELECT database, table_name, size_bytes, tier, reason, coalesce(days, -1) AS days_ago FROM ({CLASSIFIED_SQL})",
)
def _classify(t: Tables):
    return classified(t).select(
        "database", "table_name", "size_bytes", "tier", "reason",
        F.coalesce("last_queried_days_ago", F.lit(-1)).alias("days_ago"),
    )


@REG.query(
    "tier_entities",
    """WITH e AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS size, max(o_orderdate) AS last_used FROM orders GROUP BY 1),
       d AS (SELECT *, CAST(floor((epoch_us(TIMESTAMP '2001-08-02 00:00:00') - epoch_us(last_used)) / 86400000000) AS INTEGER) AS days FROM e)
       SELECT o_custkey, CAST(size AS DOUBLE) AS size, days AS last_queried_days_ago,
              CASE WHEN days >= 200 THEN 'TIER_3' WHEN size < 1200000 THEN 'TIER_1' ELSE 'TIER_2' END AS tier FROM d""",
)
def _entities(t: Tables):
    tiers = inv.tier_entities(
        t.orders, "o_custkey", F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderdate"), as_of(), 1200000, 200
    )
    return tiers.select("o_custkey", F.col("size").cast("double").alias("size"), "last_queried_days_ago", "tier")


REG.add("filter_by_tier",
        lambda t: inv.filter_by_tier(classified(t), "TIER_1").select("database", "table_name", "size_bytes", "tier"),
        f"SELECT database, table_name, size_bytes, tier FROM ({CLASSIFIED_SQL}) WHERE tier = 'TIER_1'")
REG.add("tables_with_maps",
        lambda t: inv.tables_with_maps(customer_inventory(t)).select("database", "table_name", "row_count"),
        f"SELECT database, table_name, row_count FROM ({INVENTORY_SQL}) WHERE has_maps")
REG.add("tier_counts",
        lambda t: inv.tier_counts(classified(t)),
        f"""SELECT count(*) AS total_tables, count(*) FILTER (WHERE tier = 'TIER_1') AS tier1_count,
            count(*) FILTER (WHERE tier = 'TIER_2') AS tier2_count, count(*) FILTER (WHERE tier = 'TIER_3') AS tier3_count
            FROM ({CLASSIFIED_SQL})""")  # fmt: skip


# classifications exist for customers with a finished order only, so that some tables are unclassified
def _classifications(t: Tables) -> DataFrame:
    return classified(t).filter("last_queried IS NOT NULL").select("database", "table_name", "tier", "reason")


@REG.query(
    "tier_summary",
    f"""WITH c AS (SELECT * REPLACE (CASE WHEN last_queried IS NOT NULL THEN tier END AS tier) FROM ({CLASSIFIED_SQL}))
    SELECT count(*) AS total_tables,
      count(*) FILTER (WHERE tier = 'TIER_1') AS tier1_count, CAST(coalesce(sum(size_bytes) FILTER (WHERE tier = 'TIER_1'), 0) AS BIGINT) AS tier1_size_bytes,
      count(*) FILTER (WHERE tier = 'TIER_2') AS tier2_count, CAST(coalesce(sum(size_bytes) FILTER (WHERE tier = 'TIER_2'), 0) AS BIGINT) AS tier2_size_bytes,
      count(*) FILTER (WHERE tier = 'TIER_3') AS tier3_count, CAST(coalesce(sum(size_bytes) FILTER (WHERE tier = 'TIER_3'), 0) AS BIGINT) AS tier3_size_bytes
    FROM c""",
)
def _summary(t: Tables):
    tables = customer_inventory(t).join(_classifications(t), list(inv.TABLE_KEY), "left")
    return inv.tier_summary(tables)


REG.add("tier_rollup",
        lambda t: inv.tier_rollup(classified(t)).select(
            F.coalesce("database", F.lit("all")).alias("database"), F.coalesce("tier", F.lit("all")).alias("tier"),
            F.col("level").cast("bigint").alias("level"), "tables", "size_bytes"),
        f"""SELECT coalesce(database, 'all') AS database, coalesce(tier, 'all') AS tier, CAST(GROUPING_ID(database, tier) AS BIGINT) AS level,
            count(*) AS tables, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM ({CLASSIFIED_SQL}) GROUP BY ROLLUP (database, tier)""")  # fmt: skip
REG.add("severity_counts",
        lambda t: inv.severity_counts(
            t.events.select("user_id", F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO").alias("severity")),
            ["user_id"]),
        """SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS passed_count,
           count(*) FILTER (WHERE event_type = 'error') AS failed_count FROM events GROUP BY 1""")  # fmt: skip

# -- classification joins ---------------------------------------------------------------------------

REG.add("join_classification",
        lambda t: inv.join_classification(customer_inventory(t), _classifications(t)).select("database", "table_name", "size_bytes", "tier"),
        f"SELECT database, table_name, size_bytes, tier FROM ({CLASSIFIED_SQL}) WHERE last_queried IS NOT NULL")
REG.add("classified_only",
        lambda t: inv.classified_only(customer_inventory(t), _classifications(t)).select("database", "table_name", "size_bytes"),
        f"SELECT database, table_name, size_bytes FROM ({INVENTORY_SQL}) WHERE last_queried IS NOT NULL")
REG.add("unclassified",
        lambda t: inv.unclassified(customer_inventory(t), _classifications(t)).select("database", "table_name", "size_bytes"),
        f"SELECT database, table_name, size_bytes FROM ({INVENTORY_SQL}) WHERE last_queried IS NULL")

# -- lines of business and waves ----------------------------------------------------------------------

LOBS = ["Blue", "red", "small", "Old", "o", "BLUE bolt"]
_LOB_SQL = """CASE WHEN lower(table_name) LIKE 'blue bolt%' THEN 'BLUE bolt' WHEN lower(table_name) LIKE 'small%' THEN 'small'
    WHEN lower(table_name) LIKE 'blue%' THEN 'Blue' WHEN lower(table_name) LIKE 'old%' THEN 'Old'
    WHEN lower(table_name) LIKE 'red%' THEN 'red' WHEN lower(table_name) LIKE 'o%' THEN 'o' ELSE 'BLUE bolt' END"""


def part_classifications(t: Tables) -> DataFrame:
    """One row per part; sold quantity is the size, the last shipment the last use."""
    sold = inv.tier_entities(
        t.lineitem, "l_partkey", F.col("l_quantity").cast("bigint"), F.col("l_shipdate"),
        F.lit("2001-12-01").cast("timestamp"), 800, 100,
    )
    return sold.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("inventory "), F.pmod("p_partkey", F.lit(2)).cast("string")).alias("inventory_id"),
        F.concat(F.lit("db"), F.col("p_partkey").cast("string")).alias("database"),
        # parts share names, so tables of many databases do
        F.col("p_name").alias("table_name"),
        "tier",
        F.col("p_partkey").alias("position"),
    )


_PARTS_SQL = """
SELECT 'inventory ' || p_partkey % 2 AS inventory_id, 'db' || p_partkey AS database, p_name AS table_name, p_partkey AS position,
       CASE WHEN days >= 100 THEN 'TIER_3' WHEN size < 800 THEN 'TIER_1' ELSE 'TIER_2' END AS tier
FROM (SELECT l_partkey, sum(l_quantity) AS size,
             floor((epoch_us(TIMESTAMP '2001-12-01 00:00:00') - epoch_us(max(l_shipdate))) / 86400000000) AS days
      FROM lineitem GROUP BY 1) s JOIN part ON l_partkey = p_partkey
"""
_WAVES_SQL = f"""
WITH l AS (SELECT *, {_LOB_SQL} AS lob FROM ({_PARTS_SQL})),
w AS (SELECT inventory_id, lob, count(*) AS table_count, row_number() OVER (PARTITION BY inventory_id ORDER BY lob) AS wave FROM l GROUP BY 1, 2)
SELECT l.inventory_id, database, 'wave-' || wave AS wave_id, 'Wave ' || wave AS name, l.lob, table_count,
       CAST(greatest(10, ceil(table_count / 50) * 10) AS BIGINT) AS estimated_days,
       CAST(floor((wave - 1) / 3) AS BIGINT) AS parallel_group, table_name, tier,
       row_number() OVER (PARTITION BY l.inventory_id, l.lob ORDER BY tier, position) AS place
FROM l JOIN w ON l.lob = w.lob AND l.inventory_id = w.inventory_id
"""

REG.add("assign_lob",
        lambda t: inv.assign_lob(part_classifications(t), LOBS).select("database", "table_name", "lob"),
        f"SELECT database, table_name, {_LOB_SQL} AS lob FROM ({_PARTS_SQL})")
REG.add("plan_waves",
        lambda t: waves.plan_waves(part_classifications(t), LOBS, plans=["inventory_id"]),
        f"SELECT inventory_id, database, wave_id, name, lob, place, table_name, tier, estimated_days, parallel_group FROM ({_WAVES_SQL})")
REG.add("wave_plan_report",
        lambda t: waves.wave_plan_report(part_classifications(t), LOBS, plans=["inventory_id"]),
        f"""WITH p AS MATERIALIZED ({_WAVES_SQL}), n AS (SELECT inventory_id, count(DISTINCT lob) AS total_waves, count(*) AS total_tables FROM p GROUP BY 1)
            SELECT DISTINCT inventory_id, wave_id, name, lob, table_count, estimated_days, parallel_group, total_waves, total_tables FROM p JOIN n USING (inventory_id)""")  # fmt: skip


_PREFIX_SQL = """WITH p AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS prefix FROM part
                  UNION SELECT DISTINCT upper(left(p_name, 5)) FROM part WHERE p_size > 20
                  UNION SELECT DISTINCT p_name FROM part WHERE p_size = 7),
       u AS (SELECT lower(prefix) AS key, min(prefix) AS prefix FROM p GROUP BY 1),
       m AS (SELECT p_partkey, u.prefix, row_number() OVER (PARTITION BY p_partkey ORDER BY length(key) DESC) AS rn
             FROM part LEFT JOIN u ON starts_with(lower(p_name), key))
       SELECT p_partkey, prefix FROM m WHERE rn = 1"""


def _name_prefixes(t: Tables):
    part = t.part
    return (
        part.select(F.split("p_name", " ")[0].alias("prefix"))
        .union(part.filter("p_size > 20").select(F.upper(F.substring("p_name", 1, 5))))
        .union(part.filter("p_size = 7").select("p_name"))
        .distinct()
    )


REG.add("prefix_join",
        lambda t: inv.prefix_join(t.part, "p_name", _name_prefixes(t), "prefix", "prefix").select("p_partkey", "prefix"),
        _PREFIX_SQL)
REG.add("prefix_join_by_order",
        lambda t: inv.prefix_join_by_order(t.part.select("p_partkey", "p_name"), "p_name", _name_prefixes(t), "prefix", "prefix", hot_rows=500).select("p_partkey", "prefix"),
        _PREFIX_SQL)


# -- logs: line items stand for log files, one table per supplier ---------------------------------------

_LOG_PATH_SQL = "'lake/' || l_returnflag || '/s' || l_suppkey || '/_delta_log/' || l_orderkey || '.json'"
_LOGS_SQL = f"""
SELECT table_path, table_name, CAST(sum(length) AS BIGINT) AS log_bytes FROM (
  SELECT regexp_extract(path, '^(.*?)/_delta_log/', 1) AS table_path, regexp_extract(path, '([^/]+)/_delta_log/', 1) AS table_name, length
  FROM (SELECT {_LOG_PATH_SQL} AS path, CAST(l_quantity AS BIGINT) * 1800 AS length FROM lineitem)) GROUP BY 1, 2
"""


def log_files(t: Tables) -> DataFrame:
    path = F.concat(
        F.lit("lake/"), "l_returnflag", F.lit("/s"), F.col("l_suppkey").cast("string"),
        F.lit("/_delta_log/"), F.col("l_orderkey").cast("string"), F.lit(".json"),
    )
    return t.lineitem.select(path.alias("path"), (F.col("l_quantity").cast("bigint") * 1800).alias("length"))


_HEALTH_SQL = """CASE WHEN log_size_mb >= 10 THEN {0} WHEN log_size_mb >= 9 THEN {1} WHEN log_size_mb >= 7 THEN {2} ELSE {3} END"""
_STATUS_SQL = _HEALTH_SQL.format("'BLOCKED'", "'CRITICAL'", "'WARNING'", "'HEALTHY'")
_ADVICE_SQL = _HEALTH_SQL.format(
    "'Must compact Delta log before migration'", "'Run OPTIMIZE followed by VACUUM'", "'Run OPTIMIZE to reduce log size'", "'No action needed'"
)
_REDUCTION_SQL = _HEALTH_SQL.format("80.0", "60.0", "40.0", "0.0")

REG.add("log_table_name",
        lambda t: inv.log_sizes(log_files(t)),
        _LOGS_SQL)
REG.add("log_health",
        lambda t: inv.log_health(inv.log_sizes(log_files(t))).select("table_path", "table_name", "log_size_mb", "status", "recommendation"),
        f"""SELECT table_path, table_name, log_size_mb, {_STATUS_SQL} AS status, {_ADVICE_SQL} AS recommendation
            FROM (SELECT *, log_bytes / 1048576 AS log_size_mb FROM ({_LOGS_SQL}))""")  # fmt: skip
REG.add("compaction_plan",
        lambda t: inv.compaction_plan(inv.log_sizes(log_files(t))).select("table_path", "table_name", "current_size_bytes", "estimated_reduction_pct", "recommended_action"),
        f"""SELECT table_path, table_name, log_bytes AS current_size_bytes, CAST({_REDUCTION_SQL} AS DOUBLE) AS estimated_reduction_pct,
            {_ADVICE_SQL} AS recommended_action FROM (SELECT *, log_bytes / 1048576 AS log_size_mb FROM ({_LOGS_SQL}))""")  # fmt: skip
