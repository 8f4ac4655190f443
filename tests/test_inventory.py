from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeproof.operators import inventory as inv
from lakeproof.operators import waves

NOW = datetime(2025, 6, 1, 12, 0)
TB = 2**40


def tables(spark, rows):
    return spark.createDataFrame(rows, "database STRING, table_name STRING, size_bytes BIGINT, last_queried TIMESTAMP")


def classified(spark, rows):
    return inv.classify_tiers(tables(spark, rows), F.lit("2025-06-01 12:00:00").cast("timestamp"))


@pytest.mark.parametrize(
    "age, size, tier, days, reason",
    [
        (timedelta(days=89), 10, "TIER_1", 89, "Queried 89 days ago, size < 1 TB"),
        (timedelta(days=90), 10, "TIER_3", 90, "Not queried in 90 days (>= 90)"),
        (timedelta(days=5), TB - 1, "TIER_1", 5, "Queried 5 days ago, size < 1 TB"),
        (timedelta(days=5), TB, "TIER_2", 5, "Queried 5 days ago, size >= 1 TB"),
        (timedelta(days=400), 2 * TB, "TIER_3", 400, "Not queried in 400 days (>= 90)"),
        (timedelta(hours=-1), 10, "TIER_1", -1, "Queried -1 days ago, size < 1 TB"),
        (None, 10, "TIER_3", None, "Table has never been queried"),
    ],
)
def test_tier_boundaries(spark, age, size, tier, days, reason):
    row = classified(spark, [("d", "t", size, None if age is None else NOW - age)]).first()
    assert (row["tier"], row["last_queried_days_ago"], row["reason"]) == (tier, days, reason)


def test_tier_counts_include_empty_tiers(spark):
    rows = classified(spark, [("d", "a", 1, NOW), ("d", "b", 1, None)])
    assert inv.tier_counts(rows).first().asDict() == {"total_tables": 2, "tier1_count": 1, "tier2_count": 0, "tier3_count": 1}
    assert inv.filter_by_tier(rows, "TIER_3").first()["table_name"] == "b"


def test_summary_counts_unclassified_in_the_total_only(spark):
    rows = spark.createDataFrame([("a", 5, "TIER_1"), ("b", 7, None), ("c", 9, "TIER_1")], "t STRING, size_bytes BIGINT, tier STRING")
    row = inv.tier_summary(rows).first()
    assert (row["total_tables"], row["tier1_count"], row["tier1_size_bytes"], row["tier2_size_bytes"]) == (3, 2, 14, 0)


def test_equal_names_of_two_databases_stay_apart(spark):
    rows = classified(spark, [("x", "t", 1, NOW), ("y", "t", 1, None)])
    joined = inv.join_classification(rows.select("database", "table_name"), rows.select("database", "table_name", "tier"))
    assert {(r["database"], r["tier"]) for r in joined.collect()} == {("x", "TIER_1"), ("y", "TIER_3")}


def test_schema_with_maps():
    assert inv.schema_has_maps(T.StructType([T.StructField("a", T.ArrayType(T.MapType(T.StringType(), T.LongType())))]))
    assert not inv.schema_has_maps(T.StructType([T.StructField("a", T.ArrayType(T.StringType()))]))


@pytest.mark.parametrize(
    "mb, status, reduction",
    [(0, "HEALTHY", 0.0), (5, "HEALTHY", 0.0), (6.9, "HEALTHY", 0.0), (7, "WARNING", 40.0), (8.9, "WARNING", 40.0),
     (9, "CRITICAL", 60.0), (9.9, "CRITICAL", 60.0), (10, "BLOCKED", 80.0), (100, "BLOCKED", 80.0)],
)
def test_log_limits(spark, mb, status, reduction):
    logs = spark.createDataFrame([("t", int(mb * 1048576) + (0 if float(mb).is_integer() else 1))], "table_name STRING, log_bytes BIGINT")
    assert inv.log_health(logs).first()["status"] == status
    assert inv.compaction_plan(logs).first()["estimated_reduction_pct"] == reduction


def test_log_paths(spark):
    files = spark.createDataFrame(
        [("s/a/t/_delta_log/0.json", 1), ("s/b/t/_delta_log/0.json", 2), ("s/b/t/_delta_log/1.json", 3), ("s/b/t/part.parquet", 9)],
        "path STRING, length BIGINT",
    )
    got = {r["table_path"]: (r["table_name"], r["log_bytes"]) for r in inv.log_sizes(files).collect()}
    assert got == {"s/a/t": ("t", 1), "s/b/t": ("t", 5)}


def test_longest_prefix_wins_and_the_first_name_is_the_rest(spark):
    rows = spark.createDataFrame([("payments.x",), ("PAY.y",), ("other",), ("zeta",)], "table_name STRING")
    got = {r["table_name"]: r["lob"] for r in inv.assign_lob(rows, ["pay", "Payments", "alpha"]).collect()}
    assert got == {"payments.x": "Payments", "PAY.y": "pay", "other": "Payments", "zeta": "Payments"}
    assert inv.assign_lob(rows, []).first()["lob"] == "default"
    names = spark.createDataFrame([("pay",), ("Payments",), ("alpha",)], "p STRING")
    joined = {r["table_name"]: r["lob"] for r in inv.prefix_join(rows, "table_name", names, "p", "lob").collect()}
    assert joined == {"payments.x": "Payments", "PAY.y": "pay", "other": None, "zeta": None}


@pytest.mark.parametrize("hot_rows", [5, 60, 100_000])
def test_prefixes_by_order(spark, hot_rows):
    rng = random.Random(hot_rows)
    word = lambda n: "".join(rng.choice("abÄ") for _ in range(rng.randint(0, n)))
    texts = [(i, word(7)) for i in range(300)] + [(300, None), (301, ""), (302, "zz"), (302, "zz")]
    names = sorted({word(5) for _ in range(60)} | {"A", "a", "ab", "zzz", ""})
    rows = spark.createDataFrame(texts, "id INT, t STRING")
    prefixes = spark.createDataFrame([(n,) for n in names] + [(None,)], "p STRING")
    plain = inv.prefix_join(rows, "t", prefixes, "p", "found")
    got = inv.prefix_join_by_order(rows, "t", prefixes, "p", "found", hot_rows=hot_rows)
    assert got.columns == plain.columns and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert {r["found"] for r in inv.prefix_join_by_order(rows, "t", prefixes.limit(0), "p", "found").collect()} == {None}


def plan(spark, rows, lobs, **options):
    frame = spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(rows)], "table_name STRING, tier STRING, position BIGINT")
    return frame, waves.plan_waves(frame, lobs, **options)


@pytest.mark.parametrize("n, days", [(1, 10), (50, 10), (51, 20), (101, 30)])
def test_wave_length(spark, n, days):
    frame, _ = plan(spark, [(f"a.{i}", "TIER_1") for i in range(n)], ["a"])
    assert waves.wave_plan_report(frame, ["a"]).first()["estimated_days"] == days


def test_waves_order_tiers_and_keep_input_order(spark):
    rows = [("b.3", "TIER_3"), ("a.2", "TIER_2"), ("a.1", "TIER_1"), ("b.1", "TIER_1"), ("a.1b", "TIER_1"), ("c", "TIER_1"), ("d", "TIER_1")]
    frame, planned = plan(spark, rows, ["a", "b", "c", "d"], max_parallel=3, hot_rows=2)
    got = [(r["wave_id"], r["lob"], r["table_name"], r["parallel_group"]) for r in planned.orderBy("wave_id", "place").collect()]
    assert got == [
        ("wave-1", "a", "a.1", 0), ("wave-1", "a", "a.1b", 0), ("wave-1", "a", "a.2", 0),
        ("wave-2", "b", "b.1", 0), ("wave-2", "b", "b.3", 0), ("wave-3", "c", "c", 0), ("wave-4", "d", "d", 1),
    ]
    report = waves.wave_plan_report(frame, ["a", "b", "c", "d"]).first()
    assert (report["total_waves"], report["total_tables"]) == (4, 7)


def test_empty_plan(spark):
    frame, planned = plan(spark, [], ["a"])
    assert planned.count() == 0
    assert waves.wave_plan_report(frame, ["a"]).count() == 0
