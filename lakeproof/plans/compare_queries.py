"""Table comparison bound to orders, lineitem, customer and part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lakeproof.operators import compare, key_tree, sketches
from lakeproof.plans.altered import (
    CUSTOMER_TARGET_SQL,
    LINEITEM_TARGET_SQL,
    ORDERS_TARGET_SQL,
    customer_target,
    lineitem_target,
    orders_target,
)
from lakeproof.plans.registry import Registry, Tables
from lakeproof.session import scratch_path

REG = Registry()

_ROW_STATUS_SQL = f"""
WITH tgt AS ({ORDERS_TARGET_SQL}),
s AS (SELECT o_orderkey, count(*) n, min(o_custkey) a, min(o_orderstatus) b, min(o_totalprice) c,
             min(o_orderdate) d, min(o_orderpriority) e FROM orders GROUP BY 1),
t AS (SELECT o_orderkey, count(*) n, min(o_custkey) a, min(o_orderstatus) b, min(o_totalprice) c,
             min(o_orderdate) d, min(o_orderpriority) e FROM tgt GROUP BY 1),
j AS (SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, s.n AS sn, t.n AS tn,
             s.a IS NOT DISTINCT FROM t.a AND s.b IS NOT DISTINCT FROM t.b AND s.c IS NOT DISTINCT FROM t.c
             AND s.d IS NOT DISTINCT FROM t.d AND s.e IS NOT DISTINCT FROM t.e AS same
      FROM s FULL OUTER JOIN t ON s.o_orderkey = t.o_orderkey)
SELECT o_orderkey, CASE WHEN coalesce(sn, 0) > 1 OR coalesce(tn, 0) > 1 THEN 'duplicate_key'
            WHEN tn IS NULL THEN 'missing' WHEN sn IS NULL THEN 'extra'
            WHEN same THEN 'matched' ELSE 'changed' END AS status
FROM j
"""


@REG.query(
    "compare_row_count",
    f"""WITH tgt AS ({LINEITEM_TARGET_SQL}), n AS (
        SELECT (SELECT count(*) FROM lineitem) AS source_rows, (SELECT count(*) FROM tgt) AS target_rows)
        SELECT source_rows, target_rows, source_rows = target_rows AS matched FROM n""",
)
def _row_count(t: Tables):
    return compare.compare_row_count(t.lineitem, lineitem_target(t.lineitem))


@REG.query(
    "compare_row_hash",
    f"SELECT status, count(*) AS n FROM ({_ROW_STATUS_SQL}) GROUP BY status",
)
def compare_orders(t: Tables):
    rows = compare.compare_row_hash(t.orders, orders_target(t.orders), ["o_orderkey"])
    return rows.groupBy("status").agg(F.count("*").alias("n"))


_LINE_VALUES = (
    "l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
)


@REG.query(
    "compare_row_hash_duplicates",
    f"""
    WITH tgt AS ({LINEITEM_TARGET_SQL}),
    s AS (SELECT l_orderkey, l_linenumber, count(*) n, {", ".join(f"min({c}) {c}" for c in _LINE_VALUES)}
          FROM lineitem GROUP BY 1, 2),
    t AS (SELECT l_orderkey, l_linenumber, count(*) n, {", ".join(f"min({c}) {c}" for c in _LINE_VALUES)}
          FROM tgt GROUP BY 1, 2),
    j AS (SELECT coalesce(s.n, 0) sn, coalesce(t.n, 0) tn,
                 {" AND ".join(f"s.{c} IS NOT DISTINCT FROM t.{c}" for c in _LINE_VALUES)} AS same
          FROM s FULL OUTER JOIN t ON s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber)
    SELECT CASE WHEN sn > 1 OR tn > 1 THEN 'duplicate_key' WHEN tn = 0 THEN 'missing' WHEN sn = 0 THEN 'extra'
                WHEN same THEN 'matched' ELSE 'changed' END AS status,
           count(*) AS n, CAST(sum(sn) AS BIGINT) AS source_rows, CAST(sum(tn) AS BIGINT) AS target_rows
    FROM j GROUP BY 1
    """,
)
def _duplicates(t: Tables):
    rows = compare.compare_row_hash(t.lineitem, lineitem_target(t.lineitem), ["l_orderkey", "l_linenumber"])
    return rows.groupBy("status").agg(
        F.count("*").alias("n"),
        F.sum("source_rows").alias("source_rows"),
        F.sum("target_rows").alias("target_rows"),
    )


def _profile_sql(columns: dict[str, str], source: str, target: str) -> str:
    def side(table: str, column: str, kind: str) -> str:
        total = f"CAST(sum(CAST({column} AS DECIMAL(28,6))) AS DOUBLE)" if kind in ("number", "double") else "CAST(NULL AS DOUBLE)"
        unusual = (
            f"count(*) FILTER (isnan({column})) AS nan_values, count(*) FILTER (isinf({column})) AS infinite_values, "
            f"count(*) FILTER (isfinite({column}) AND abs({column}) >= 1e26) AS overflow_values, "
            if kind == "double"
            else "0 AS nan_values, 0 AS infinite_values, 0 AS overflow_values, "
        )
        return f"""SELECT '{column}' AS column_name, count({column}) AS non_null, count(*) - count({column}) AS nulls,
            {unusual} count(DISTINCT {column}) AS distinct_values, CAST(min({column}) AS VARCHAR) AS min_value,
            CAST(max({column}) AS VARCHAR) AS max_value, {total} AS sum_value FROM {table}"""

    s = " UNION ALL ".join(side(source, c, k) for c, k in columns.items())
    t = " UNION ALL ".join(side("tgt", c, k) for c, k in columns.items())
    special = ["nan_values", "infinite_values", "overflow_values"]
    metrics = ["non_null", "nulls", *special, "distinct_values", "min_value", "max_value", "sum_value"]
    return f"""
    WITH tgt AS ({target}), s AS ({s}), t AS ({t})
    SELECT s.column_name, {", ".join(f"s.{m} AS source_{m}" for m in metrics)},
           s.sum_value / s.non_null AS source_mean_value,
           {", ".join(f"t.{m} AS target_{m}" for m in metrics)},
           t.sum_value / t.non_null AS target_mean_value,
           {" AND ".join(f"s.{m} IS NOT DISTINCT FROM t.{m}" for m in metrics)} AS matched
    FROM s JOIN t ON s.column_name = t.column_name
    """


_LINE_KINDS = {
    "l_orderkey": "number",
    "l_partkey": "number",
    "l_suppkey": "number",
    "l_linenumber": "number",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "text",
    "l_linestatus": "text",
    "l_shipdate": "time",
}


@REG.query("compare_column_aggregates", _profile_sql(_LINE_KINDS, "lineitem", LINEITEM_TARGET_SQL))
def _aggregates(t: Tables):
    return compare.compare_column_aggregates(t.lineitem, lineitem_target(t.lineitem))


_LINE_COLUMNS = ", ".join(_LINE_KINDS)


@REG.query(
    "compare_row_bag",
    f"""
    WITH tgt AS ({LINEITEM_TARGET_SQL}),
    s AS (SELECT {_LINE_COLUMNS}, count(*) n FROM lineitem GROUP BY ALL),
    t AS (SELECT {_LINE_COLUMNS}, count(*) n FROM tgt GROUP BY ALL),
    j AS (SELECT coalesce(s.n, 0) sn, coalesce(t.n, 0) tn FROM s FULL OUTER JOIN t ON
          {" AND ".join(f"s.{c} = t.{c}" for c in _LINE_KINDS)})
    SELECT CASE WHEN sn = tn THEN 'equal' WHEN tn = 0 THEN 'only_source' WHEN sn = 0 THEN 'only_target'
                ELSE 'other_count' END AS status,
           count(*) AS distinct_rows, CAST(sum(least(sn, tn)) AS BIGINT) AS common_rows,
           CAST(sum(sn - least(sn, tn)) AS BIGINT) AS only_source_rows,
           CAST(sum(tn - least(sn, tn)) AS BIGINT) AS only_target_rows
    FROM j GROUP BY 1
    """,
)
def _bag(t: Tables):
    rows = compare.compare_row_bag(t.lineitem, lineitem_target(t.lineitem))
    status = (
        F.when(F.col("source_rows") == F.col("target_rows"), "equal")
        .when(F.col("target_rows") == 0, "only_source")
        .when(F.col("source_rows") == 0, "only_target")
        .otherwise("other_count")
    )
    return rows.groupBy(status.alias("status")).agg(
        F.count("*").alias("distinct_rows"),
        F.sum("common_rows").alias("common_rows"),
        F.sum("only_source_rows").alias("only_source_rows"),
        F.sum("only_target_rows").alias("only_target_rows"),
    )


@REG.query(
    "changed_columns",
    f"""WITH tgt AS ({CUSTOMER_TARGET_SQL})
    SELECT s.c_custkey, concat_ws(',', CASE WHEN s.c_name <> t.c_name THEN 'c_name' END,
           CASE WHEN s.c_nationkey <> t.c_nationkey THEN 'c_nationkey' END,
           CASE WHEN s.c_acctbal <> t.c_acctbal THEN 'c_acctbal' END,
           CASE WHEN s.c_mktsegment <> t.c_mktsegment THEN 'c_mktsegment' END) AS changed
    FROM customer s JOIN tgt t ON s.c_custkey = t.c_custkey
    WHERE s.c_name <> t.c_name OR s.c_nationkey <> t.c_nationkey OR s.c_acctbal <> t.c_acctbal
          OR s.c_mktsegment <> t.c_mktsegment""",
)
def _changed(t: Tables):
    rows = compare.changed_columns(t.customer, customer_target(t.customer), ["c_custkey"])
    return rows.select("c_custkey", F.array_join("changed", ",").alias("changed"))


@REG.query(
    "bag_difference",
    f"""WITH tgt AS ({ORDERS_TARGET_SQL}),
    a AS (SELECT * FROM orders EXCEPT ALL SELECT * FROM tgt),
    b AS (SELECT * FROM tgt EXCEPT ALL SELECT * FROM orders)
    SELECT *, 'source' AS side, count(*) AS copies FROM a GROUP BY ALL
    UNION ALL SELECT *, 'target' AS side, count(*) AS copies FROM b GROUP BY ALL""",
)
def _bag_difference(t: Tables):
    return compare.bag_difference(t.orders, orders_target(t.orders))


@REG.query(
    "bag_intersection",
    f"""WITH tgt AS ({CUSTOMER_TARGET_SQL}),
    a AS (SELECT c_mktsegment, c_nationkey, c_acctbal > 5000 AS rich FROM customer
          INTERSECT ALL SELECT c_mktsegment, c_nationkey, c_acctbal > 5000 FROM tgt)
    SELECT *, count(*) AS copies FROM a GROUP BY ALL""",
)
def _bag_intersection(t: Tables):
    shape = lambda df: df.select("c_mktsegment", "c_nationkey", (F.col("c_acctbal") > 5000).alias("rich"))
    return compare.bag_intersection(shape(t.customer), shape(customer_target(t.customer)))


# copies of customer whose schema differs: a lost, an added, a retyped and a widened column, and one renamed by case, with
# equal and with other values
_RESHAPED = {
    "customer_lost": ("tier1", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer"),
    "customer_added": ("tier2", "SELECT *, c_nationkey AS c_added FROM customer"),
    "customer_retyped": ("tier1", "SELECT c_custkey, c_name, CAST(c_nationkey AS {text}) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "customer_widened": ("tier1", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "customer_cased": ("tier1", "SELECT c_custkey, c_name, c_nationkey, c_acctbal AS C_ACCTBAL, c_mktsegment FROM customer"),
    "customer_cased_changed": ("tier2", "SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1 AS C_ACCTBAL, c_mktsegment FROM customer"),
    "customer_lost_rows": ("tier3", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0"),
}


def reshaped(t: Tables, name: str):
    return t.spark.sql(_RESHAPED[name][1].format(text="STRING").replace("FROM customer", "FROM {customer}"), customer=t.customer)


def _pairs(t: Tables):
    part = t.part
    return [
        compare.TablePair("orders", "orders_copy", t.orders, orders_target(t.orders), "tier1", ["o_orderkey"]),
        compare.TablePair("customer", "customer_copy", t.customer, t.customer, "tier1", ["c_custkey"]),
        compare.TablePair("lineitem", "lineitem_copy", t.lineitem, t.lineitem, "tier1"),
        compare.TablePair("customer", "customer_changed", t.customer, customer_target(t.customer), "tier2"),
        compare.TablePair("part", "part_copy", part, part.filter("p_retailprice < 1000"), "tier3"),
        compare.TablePair("customer", "customer_renamed", t.customer, customer_target(t.customer), "tier3"),
        *[
            compare.TablePair("customer", name, t.customer, reshaped(t, name), tier, ["c_custkey"] if tier == "tier1" else ())
            for name, (tier, _) in _RESHAPED.items()
        ],
        compare.TablePair("part", "part_gone", part, lambda: t.spark.read.parquet(t.path("part_gone")), "tier2"),
    ]


_COLUMNS = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split(),
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment".split(),
    "lineitem": list(_LINE_KINDS),
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice".split(),
}
_WIDTHS = "replace(replace(column_type, 'INTEGER', 'BIGINT'), 'FLOAT', 'DOUBLE')"


def _pair_sql(source: str, target: str, tier: str, target_sql: str, shared: list[str] | None = None) -> str:
    """The verdicts of a pair, worked out check by check."""
    shared = _COLUMNS[source] if shared is None else shared
    kinds = lambda table: f"(SELECT list(lower(column_name) || ' ' || {_WIDTHS} ORDER BY lower(column_name)) FROM (DESCRIBE {table}))"
    facts = ", ".join(
        f"count({c}), count(DISTINCT {c}), min({c}), max({c})"
        + (f", sum(CAST({c} AS DECIMAL(28,6)))" if c.endswith(("price", "bal", "quantity", "discount", "tax")) else "")
        for c in shared
    )
    listed = ", ".join(shared)
    aggs = f"(SELECT row({facts}) FROM {source}) IS NOT DISTINCT FROM (SELECT row({facts}) FROM t)"
    rows = f"""NOT EXISTS (SELECT {listed} FROM {source} EXCEPT ALL SELECT {listed} FROM t)
        AND NOT EXISTS (SELECT {listed} FROM t EXCEPT ALL SELECT {listed} FROM {source})"""
    return f"""(WITH t AS ({target_sql}) SELECT '{source}' AS source_table, '{target}' AS target_table, '{tier}' AS tier,
        {kinds(f"SELECT * FROM {source}")} = {kinds(target_sql)} AS same_schema,
        (SELECT count(*) FROM {source}) = (SELECT count(*) FROM t) AS row_count,
        {aggs if tier in ("tier1", "tier2") else "NULL"} AS aggs, {rows if tier == "tier1" else "NULL"} AS hash)"""


_SHARED = {
    "customer_lost": ["c_custkey", "c_name", "c_nationkey", "c_acctbal"],
    "customer_retyped": ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"],
    "customer_lost_rows": ["c_custkey", "c_name"],
}
_PAIR_ROWS = [
    _pair_sql("orders", "orders_copy", "tier1", ORDERS_TARGET_SQL),
    _pair_sql("customer", "customer_copy", "tier1", "SELECT * FROM customer"),
    _pair_sql("lineitem", "lineitem_copy", "tier1", "SELECT * FROM lineitem"),
    _pair_sql("customer", "customer_changed", "tier2", CUSTOMER_TARGET_SQL),
    _pair_sql("part", "part_copy", "tier3", "SELECT * FROM part WHERE p_retailprice < 1000"),
    _pair_sql("customer", "customer_renamed", "tier3", CUSTOMER_TARGET_SQL),
    *[_pair_sql("customer", name, tier, sql.format(text="VARCHAR"), _SHARED.get(name)) for name, (tier, sql) in _RESHAPED.items()],
]
_FAILED = "concat_ws(',', CASE WHEN NOT same_schema THEN 'schema' END, CASE WHEN NOT row_count THEN 'row_count' END, CASE WHEN NOT aggs THEN 'column_aggregates' END, CASE WHEN NOT hash THEN 'row_hash' END)"
_VALIDATION_SQL = f"""
WITH f AS ({" UNION ALL ".join(f"SELECT * FROM {row}" for row in _PAIR_ROWS)})
SELECT source_table, target_table, tier, CASE WHEN {_FAILED} = '' THEN 'passed' ELSE 'failed' END AS status,
  concat_ws(',', CASE WHEN row_count THEN 'row_count' END, CASE WHEN aggs THEN 'column_aggregates' END, CASE WHEN hash THEN 'row_hash' END) AS checks_passed,
  {_FAILED} AS checks_failed, false AS broken
FROM f
UNION ALL SELECT 'part', 'part_gone', 'tier2', 'failed', '', 'row_count,column_aggregates', true
"""


@REG.query("tiered_validation", _VALIDATION_SQL)
def _tiered(t: Tables):
    verdicts = compare.tiered_validation(_pairs(t))
    return verdicts.withColumn("broken", F.col("error").isNotNull()).drop("error")


_DESCRIBED = lambda table: f"(SELECT lower(column_name) AS k, column_name AS c, column_type AS t FROM (DESCRIBE {table}))"
_RESHAPED_SQL = """SELECT c_custkey, c_nationkey AS C_NationKey, CAST(c_acctbal AS {text}) AS c_acctbal, c_mktsegment,
    CASE WHEN c_acctbal > 0 THEN c_name END AS c_added FROM customer"""


@REG.query(
    "compare_schema",
    f"""WITH s AS {_DESCRIBED("SELECT * FROM customer")}, t AS {_DESCRIBED(_RESHAPED_SQL.format(text="VARCHAR"))},
    n AS (SELECT * FROM (UNPIVOT (SELECT {", ".join(f"count({c}) AS {c}" for c in "c_custkey c_name c_nationkey c_acctbal c_mktsegment".split())} FROM customer) ON * INTO NAME k VALUE n)),
    m AS (SELECT * FROM (UNPIVOT (SELECT {", ".join(f"count({c}) AS {c}" for c in "c_custkey c_nationkey c_acctbal c_mktsegment c_added".split())} FROM ({_RESHAPED_SQL.format(text="VARCHAR")})) ON * INTO NAME k VALUE n)),
    j AS (SELECT coalesce(s.k, t.k) AS k, coalesce(s.c, t.c) AS column_name,
          CASE WHEN t.k IS NULL THEN 'only_source' WHEN s.k IS NULL THEN 'only_target' WHEN s.t <> t.t THEN 'type_differs' ELSE 'same' END AS status
          FROM s FULL JOIN t ON s.k = t.k)
    SELECT column_name, status, n.n AS source_non_null, m.n AS target_non_null, status = 'same' AS matched
    FROM j LEFT JOIN n ON j.k = n.k LEFT JOIN m ON j.k = m.k""",
)
def _schema(t: Tables):
    target = t.spark.sql(_RESHAPED_SQL.format(text="STRING").replace("FROM customer", "FROM {customer}"), customer=t.customer)
    return compare.compare_schema(t.customer, target).drop("source_type", "target_type")


@REG.query(
    "validation_report",
    f"""SELECT tier, count(*) AS tables_validated, count(*) FILTER (WHERE status = 'passed') AS tables_passed,
    count(*) FILTER (WHERE status <> 'passed') AS tables_failed FROM ({_VALIDATION_SQL}) GROUP BY tier""",
)
def _report(t: Tables):
    return compare.validation_report(compare.tiered_validation(_pairs(t)))


@REG.query(
    "union_all_reports",
    f"""WITH ot AS ({ORDERS_TARGET_SQL}), lt AS ({LINEITEM_TARGET_SQL}), ct AS ({CUSTOMER_TARGET_SQL}), n AS (
    SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM ot) AS target_rows
    UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lt)
    UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM ct))
    SELECT *, source_rows = target_rows AS matched FROM n""",
)
def _union_reports(t: Tables):
    named = lambda name, s, g: compare.compare_row_count(s, g).select(F.lit(name).alias("table_name"), "*")
    return (
        named("orders", t.orders, orders_target(t.orders))
        .unionByName(named("lineitem", t.lineitem, lineitem_target(t.lineitem)))
        .unionByName(named("customer", t.customer, customer_target(t.customer)))
    )


def _money(column: str):
    return F.sum(F.col(column).cast("decimal(28,6)"))


@REG.query(
    "reconcile_kpis",
    f"""WITH tgt AS ({ORDERS_TARGET_SQL}),
    a AS (SELECT CAST(count(*) AS DOUBLE) n, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) v,
          CAST(count(DISTINCT o_custkey) AS DOUBLE) c, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) p FROM orders),
    b AS (SELECT CAST(count(*) AS DOUBLE) n, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) v,
          CAST(count(DISTINCT o_custkey) AS DOUBLE) c, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) p FROM tgt),
    k AS (SELECT 'order_count' AS name, a.n AS legacy_value, b.n AS new_value, CAST(0.5 AS DOUBLE) AS tolerance_pct FROM a, b
          UNION ALL SELECT 'revenue', a.v, b.v, 2.0 FROM a, b
          UNION ALL SELECT 'buyers', a.c, b.c, 0.0 FROM a, b
          UNION ALL SELECT 'pending', a.p, b.p, 10.0 FROM a, b)
    SELECT *, new_value - legacy_value AS difference,
           abs(new_value - legacy_value) <= abs(legacy_value) * tolerance_pct / 100 AS matched FROM k""",
)
def _kpis(t: Tables):
    kpis = compare.compute_kpis(
        t.orders,
        orders_target(t.orders),
        {
            "order_count": (F.count("*"), 0.5),
            "revenue": (_money("o_totalprice"), 2.0),
            "buyers": (F.count_distinct("o_custkey"), 0.0),
            "pending": (F.count_if(F.col("o_orderstatus") == "P"), 10.0),
        },
    )
    return compare.reconcile_kpis(kpis)


@REG.query(
    "partition_compare",
    f"""WITH tgt AS ({ORDERS_TARGET_SQL}),
    s AS (SELECT strftime(o_orderdate, '%Y-%m') AS partition_value, count(*) n FROM orders GROUP BY 1),
    t AS (SELECT strftime(o_orderdate, '%Y-%m') AS partition_value, count(*) n FROM tgt GROUP BY 1),
    d AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS partition_value FROM (
          (SELECT * FROM orders EXCEPT ALL SELECT * FROM tgt) UNION ALL (SELECT * FROM tgt EXCEPT ALL SELECT * FROM orders)))
    SELECT coalesce(s.partition_value, t.partition_value) AS partition_value, coalesce(s.n, 0) AS source_rows,
           coalesce(t.n, 0) AS target_rows, d.partition_value IS NULL AS matched
    FROM s FULL OUTER JOIN t ON s.partition_value = t.partition_value
    LEFT JOIN d ON d.partition_value = coalesce(s.partition_value, t.partition_value)""",
)
def _partitions(t: Tables):
    month = F.date_format("o_orderdate", "yyyy-MM")
    return compare.partition_compare(t.orders, orders_target(t.orders), month)


# a few orders of one range of keys are changed and lost, so that most of the tree is equal
_LOCAL_TARGET_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 1 AND o_orderkey < 900 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
    o_orderdate, o_orderpriority FROM orders WHERE NOT (o_orderkey % 11 = 3 AND o_orderkey < 500)"""


def locally_changed(orders):
    price = F.when(F.expr("o_orderkey % 7 = 1 AND o_orderkey < 900"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return orders.withColumn("o_totalprice", price).filter("NOT (o_orderkey % 11 = 3 AND o_orderkey < 500)")


_DIFFERENT_SQL = "SELECT * FROM ({}) WHERE status <> 'matched'"
REG.add(
    "compare_by_tree",
    lambda t: key_tree.compare_by_tree(t.orders, locally_changed(t.orders), ["o_orderkey"]).rows.filter("status <> 'matched'").select("o_orderkey", "status"),
    _DIFFERENT_SQL.format(_ROW_STATUS_SQL.replace(ORDERS_TARGET_SQL, _LOCAL_TARGET_SQL)),
)
REG.add(
    "compare_by_tree_everywhere",
    lambda t: key_tree.compare_by_tree(t.orders, orders_target(t.orders), ["o_orderkey"], leaf_rows=1000).rows.filter("status <> 'matched'").select("o_orderkey", "status"),
    _DIFFERENT_SQL.format(_ROW_STATUS_SQL),
)

_TREE_WIDTH = "(SELECT max(o_orderkey) - min(o_orderkey) + 1 FROM orders)"
_TREE_LEVEL = """SELECT {level} AS level, CAST(count(*) AS BIGINT) AS nodes, count(*) FILTER (NOT same) AS unequal_nodes, CAST(sum(n) AS BIGINT) AS rows_read,
    CAST(coalesce(sum(n) FILTER (NOT same), 0) AS BIGINT) AS unequal_rows FROM l{level}"""


def _tree_sql(levels: int, fanout: int) -> str:
    """Nodes of each level: rows of both copies under the unequal nodes above, and whether a row differs."""
    sizes = ["w.width"]
    for _ in range(levels):
        sizes.append(f"(({sizes[-1]} + {fanout - 1}) // {fanout})")
    parts = ["both_ AS (SELECT *, 0 AS side FROM orders UNION ALL SELECT *, 1 FROM tgt)", f"w AS (SELECT min(o_orderkey) AS low, {_TREE_WIDTH} AS width FROM orders)"]
    parts.append("odd AS ((SELECT * FROM orders EXCEPT SELECT * FROM tgt) UNION ALL (SELECT * FROM tgt EXCEPT SELECT * FROM orders))")
    for k in range(levels):
        node = f"(o_orderkey - w.low) // {sizes[k]}"
        above = f"WHERE (o_orderkey - w.low) // {sizes[k - 1]} IN (SELECT node FROM l{k - 1} WHERE NOT same)" if k else ""
        parts.append(f"""l{k} AS (SELECT {node} AS node, count(*) AS n, {node} NOT IN (SELECT {node} FROM odd, w) AS same FROM both_, w {above} GROUP BY {node}, w.low, w.width)""")
    return f"WITH tgt AS ({_LOCAL_TARGET_SQL}), {', '.join(parts)} {' UNION ALL '.join(_TREE_LEVEL.format(level=k) for k in range(levels))}"


REG.add(
    "compare_tree_levels",
    lambda t: key_tree.compare_by_tree(t.orders, locally_changed(t.orders), ["o_orderkey"], fanout=8, leaf_rows=0).level_table().filter("level < 3"),
    _tree_sql(3, 8),
)


_SKETCHED = {"orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate"]}


@REG.query(
    "sketch_differences",
    f"""WITH tgt AS ({ORDERS_TARGET_SQL}) {" UNION ALL ".join(
        f'''SELECT '{c}' AS column_name, (SELECT count({c}) FROM orders) AS source_non_null, (SELECT count({c}) FROM tgt) AS target_non_null,
        (SELECT count(*) FROM (SELECT {c} FROM orders EXCEPT SELECT {c} FROM tgt)) AS only_source, (SELECT count(*) FROM (SELECT {c} FROM tgt EXCEPT SELECT {c} FROM orders)) AS only_target,
        true AS within_bounds'''
        for c in _SKETCHED["orders"])}""",
)
def _sketches(t: Tables):
    """Differences from stored sketches of monthly partitions, beside the exact ones."""
    columns, month, found = _SKETCHED["orders"], F.date_format("o_orderdate", "yyyy-MM"), []
    target = orders_target(t.orders)
    for df in (t.orders, target):
        path = scratch_path(t.spark, "sketches")
        sketches.write_sketches(sketches.sketch_columns(df, columns, month), path)
        found.append(sketches.read_sketches(t.spark, path))
    exact = None
    for c in columns:
        values = t.orders.select(F.col(c).alias("v"), F.lit(0).alias("s")).unionByName(target.select(F.col(c).alias("v"), F.lit(1).alias("s")))
        sides = values.groupBy("v").agg(F.min("s").alias("low"), F.max("s").alias("high"))
        row = sides.agg(F.count_if(F.col("high") == 0).alias("exact_source"), F.count_if(F.col("low") == 1).alias("exact_target")).withColumn("column_name", F.lit(c))
        exact = row if exact is None else exact.unionByName(row)
    both = sketches.sketch_differences(*found).join(exact, "column_name")
    within = reduce(lambda a, b: a & b, [F.abs(F.col(f"only_{side}") - F.col(f"exact_{side}")) <= 4 * F.col("standard_error") for side in ("source", "target")])
    return both.select(
        "column_name", "source_non_null", "target_non_null", F.col("exact_source").alias("only_source"), F.col("exact_target").alias("only_target"), within.alias("within_bounds")
    )
