"""Graphs over whole tables.

One graph holds three kinds of parts: the tree region > nation > customer > order, the turns of each
conversation as a chain, and suppliers with the parts they delivered. Pages are nodes without edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.operators import graph
from lakeproof.plans.registry import Registry, Tables

REG = Registry()


def _name(prefix: str, *keys: str | Column) -> Column:
    parts = [F.lit(prefix)]
    for k in keys:
        parts += [F.lit("/"), (F.col(k) if isinstance(k, str) else k).cast("string")]
    return F.concat(*parts)


def tree_edges(t: Tables) -> DataFrame:
    nations = t.nation.select(_name("region", "n_regionkey").alias("src"), _name("nation", "n_nationkey").alias("dst"))
    customers = t.customer.select(_name("nation", "c_nationkey").alias("src"), _name("customer", "c_custkey").alias("dst"))
    orders = t.orders.select(_name("customer", "o_custkey").alias("src"), _name("order", "o_orderkey").alias("dst"))
    return nations.unionByName(customers).unionByName(orders)


def chain_edges(t: Tables) -> DataFrame:
    return t.conversations.filter("turn > 0").select(
        _name("turn", "conv_id", F.col("turn") - 1).alias("src"), _name("turn", "conv_id", "turn").alias("dst")
    )


def supply_edges(t: Tables) -> DataFrame:
    # the table holds a pair once per line, the graph once
    pairs = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    return pairs.select(_name("supplier", "l_suppkey").alias("src"), _name("part", "l_partkey").alias("dst"))


def all_edges(t: Tables) -> DataFrame:
    return tree_edges(t).unionByName(chain_edges(t)).unionByName(supply_edges(t))


def page_nodes(t: Tables) -> DataFrame:
    return t.pages.select(_name("page", "page_id").alias("node"))


TREE_SQL = """
SELECT 'region/' || n_regionkey AS src, 'nation/' || n_nationkey AS dst FROM nation
UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey FROM customer
UNION ALL SELECT 'customer/' || o_custkey, 'order/' || o_orderkey FROM orders
"""
CHAIN_SQL = "SELECT 'turn/' || conv_id || '/' || (turn - 1) AS src, 'turn/' || conv_id || '/' || turn AS dst FROM conversations WHERE turn > 0"
SUPPLY_SQL = "SELECT DISTINCT 'supplier/' || l_suppkey AS src, 'part/' || l_partkey AS dst FROM lineitem"
EDGES_SQL = f"{TREE_SQL} UNION ALL {CHAIN_SQL} UNION ALL {SUPPLY_SQL}"
NODES_SQL = f"""
SELECT src AS node FROM ({EDGES_SQL}) UNION SELECT dst FROM ({EDGES_SQL}) UNION SELECT 'page/' || page_id FROM pages
"""
_CASCADE_SQL = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({EDGES_SQL})), n AS MATERIALIZED ({NODES_SQL}),
r AS MATERIALIZED (SELECT node AS root FROM n WHERE node NOT IN (SELECT dst FROM e)),
b AS (SELECT root, dst AS dependent, 1 AS depth FROM r JOIN e ON root = src
      UNION ALL SELECT b.root, e.dst, depth + 1 FROM b JOIN e ON b.dependent = e.src),
m AS (SELECT root, dependent, min(depth) AS depth FROM b GROUP BY 1, 2)
SELECT r.root, coalesce(dependent, '') AS dependent, CAST(coalesce(depth, 0) AS INTEGER) AS depth FROM r LEFT JOIN m ON r.root = m.root
"""
# the parts of the graph are told apart by their tables; only suppliers need propagation, over shared parts
_COMPONENTS_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
e AS MATERIALIZED (SELECT DISTINCT a.s AS u, b.s AS v FROM d a JOIN d b ON a.p = b.p WHERE a.s <> b.s),
cc(s, c) USING KEY (s) AS (
  SELECT DISTINCT s, s FROM d
  UNION
  SELECT e.v, min(cc.c) FROM cc JOIN e ON cc.s = e.u JOIN recurring.cc AS old ON old.s = e.v WHERE cc.c < old.c GROUP BY e.v),
g AS (
  SELECT 'region/' || r_regionkey AS member, 'r' || r_regionkey AS grp FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
  UNION ALL SELECT 'nation/' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'order/' || o_orderkey, 'r' || n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'turn/' || conv_id || '/' || turn, 'c' || conv_id FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn > 0)
  UNION ALL SELECT 'supplier/' || s, 's' || c FROM cc
  UNION ALL SELECT DISTINCT 'part/' || p, 's' || c FROM d JOIN cc USING (s)
  UNION ALL SELECT 'page/' || page_id, 'p' || page_id FROM pages)
SELECT min(member) OVER (PARTITION BY grp) AS component, member FROM g
"""

REG.add("graph_nodes", lambda t: graph.graph_nodes(all_edges(t), page_nodes(t)), NODES_SQL)
REG.add("graph_roots", lambda t: graph.graph_roots(all_edges(t), page_nodes(t)),
        f"SELECT node FROM ({NODES_SQL}) WHERE node NOT IN (SELECT dst FROM ({EDGES_SQL}))")
REG.add("cascade",
        lambda t: graph.cascade(all_edges(t), page_nodes(t)).withColumn("dependent", F.coalesce("dependent", F.lit(""))),
        _CASCADE_SQL)
REG.add("co_migration_batches", lambda t: graph.co_migration_batches(all_edges(t), page_nodes(t)), _COMPONENTS_SQL)
REG.add("co_migration_batch_sizes",
        lambda t: graph.batch_sizes(graph.co_migration_batches(all_edges(t), page_nodes(t))),
        f"SELECT component, count(*) AS members FROM ({_COMPONENTS_SQL}) GROUP BY 1")


@REG.query(
    "cascade_summary",
    f"""SELECT (SELECT count(DISTINCT root) FROM ({_CASCADE_SQL})) AS roots, (SELECT max(depth) FROM ({_CASCADE_SQL})) AS greatest_depth,
        (SELECT count(DISTINCT component) FROM ({_COMPONENTS_SQL})) AS groups""",
)
def _summary(t: Tables):
    edges, nodes = all_edges(t), page_nodes(t)
    return graph.cascade_summary(graph.cascade(edges, nodes), graph.co_migration_batches(edges, nodes))
