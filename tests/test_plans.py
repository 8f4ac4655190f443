"""Physical plans: what must not be in any of them, and what must be in some."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from lakeproof.operators import compare, lookups
from lakeproof.plans import catalog, report_queries, stream_queries
from lakeproof.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
BATCH = sorted(set(QUERIES) - set(stream_queries.REG.queries))

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")

# explicit broadcasts: literals of fixed size, and bounded lists of hot partitions
BOUNDED_BROADCASTS = {
    "fn_values_clause", "transition_audit", "wave_status_rules", "window_ranks", "window_ranks_sampled", "prefix_join_by_order",
    "plan_waves", "fn_row_number", "fn_cume_dist", "fn_ntile", "fn_nth_value",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_automatic_broadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n in names:
        spark.conf.unset(n)


@pytest.mark.parametrize("name", BATCH)
def test_no_loop_joins_no_python_and_no_unbounded_broadcasts(spark, no_automatic_broadcast, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for operator in ("CartesianProduct", "NestedLoopJoin", "PythonUDF", "ArrowEvalPython", "InPandas"):
        assert operator not in text
    assert ("BroadcastExchange" in text) == (name in BOUNDED_BROADCASTS)


def columns_read(text: str) -> list[set[str]]:
    return [set(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text)]


def test_keyed_comparison_has_no_join_and_two_shuffles(spark):
    t = Tables(spark, FOLDER)
    text = plan(compare.compare_row_hash(t.orders, t.orders, ["o_orderkey"]))
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 1
    assert text.count("HashAggregate") == 2


def test_row_counts_read_no_columns(spark):
    t = Tables(spark, FOLDER)
    assert columns_read(plan(compare.compare_row_count(t.lineitem, t.lineitem))) == [set(), set()]


def test_pruning_and_pushdown(spark):
    report = plan(report_queries.user_activity(Tables(spark, FOLDER), "2024-01-31 00:00:00", 31))
    assert columns_read(report) == [{"ts", "user_id", "event_type", "props"}]
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in report
    t = Tables(spark, FOLDER)
    # counts and extremes, distinct values, and exact sums of doubles: an aggregate each per copy
    assert columns_read(plan(compare.compare_column_aggregates(t.customer, t.customer, ["c_acctbal"]))) == [{"c_acctbal"}] * 6
    assert columns_read(plan(compare.compare_column_aggregates(t.customer, t.customer, ["c_custkey"]))) == [{"c_custkey"}] * 4
    assert columns_read(plan(compare.compare_column_aggregates(t.customer, t.customer, ["c_custkey"], exact_distinct=False))) == [{"c_custkey"}] * 2


def test_top_rows_are_kept_per_task(spark):
    t = Tables(spark, FOLDER)
    assert "TakeOrderedAndProject" in plan(lookups.ordered_limit(t.orders, [F.desc("o_totalprice")], 10))


def test_all_rules_run_in_the_scan_stage(spark):
    t = Tables(spark, FOLDER)
    from lakeproof.operators import text_rules

    assert "Exchange" not in plan(text_rules.apply_rules(t.documents.select("doc_id", "text"), "text"))
