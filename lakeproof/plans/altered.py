"""Altered copies of tables, derived by expression, for the comparison queries.

The same expressions are given as SQL so that the oracle sees the same target copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a loss of cheap orders, a price change on one status and priority, and new keys for the dearest orders
ORDERS_TARGET_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM orders WHERE o_totalprice >= 5000
UNION ALL
SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_totalprice > 495000
"""


def orders_target(orders: DataFrame) -> DataFrame:
    price = F.when(
        (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "2-HIGH"), F.col("o_totalprice") + 1
    ).otherwise(F.col("o_totalprice"))
    kept = orders.filter("o_totalprice >= 5000").withColumn("o_totalprice", price)
    extra = orders.filter("o_totalprice > 495000").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return kept.unionByName(extra)


# line items of one flag and mode get another discount, the smallest quantities are lost
LINEITEM_TARGET_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 0.5 ELSE l_discount END AS l_discount,
       l_tax, l_returnflag, l_linestatus, l_shipdate
FROM lineitem WHERE NOT (l_quantity = 1 AND l_linestatus = 'F')
"""


def lineitem_target(lineitem: DataFrame) -> DataFrame:
    discount = F.when(
        (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), F.lit(0.5)
    ).otherwise(F.col("l_discount"))
    return lineitem.filter("NOT (l_quantity = 1 AND l_linestatus = 'F')").withColumn("l_discount", discount)


# customers of one segment are renamed and get another balance
CUSTOMER_TARGET_SQL = """
SELECT c_custkey,
       CASE WHEN c_mktsegment = 'BUILDING' THEN upper(c_name) ELSE c_name END AS c_name,
       c_nationkey,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
       c_mktsegment
FROM customer
"""


def customer_target(customer: DataFrame) -> DataFrame:
    return customer.select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"),
        "c_nationkey",
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_acctbal") + 1)
        .otherwise(F.col("c_acctbal"))
        .alias("c_acctbal"),
        "c_mktsegment",
    )
