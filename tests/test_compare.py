from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeproof.operators import compare, key_tree

SCHEMA = "k INT, name STRING, amount DOUBLE"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def statuses(df):
    return {r["k"]: r["status"] for r in df.collect()}


def test_statuses_per_key(spark):
    source = frame(spark, [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0), (5, "e", 5.0), (5, "e", 5.0), (None, "n", 0.0)])
    target = frame(spark, [(1, "a", 1.0), (2, "b", 2.5), (4, "d", 4.0), (5, "e", 5.0), (None, "n", 0.0)])
    assert statuses(compare.compare_row_hash(source, target, ["k"])) == {
        1: "matched", 2: "changed", 3: "missing", 4: "extra", 5: "duplicate_key", None: "matched",
    }


def test_null_and_empty_and_shifted_nulls_differ(spark):
    schema = "k INT, a STRING, b STRING"
    source = frame(spark, [(1, None, "x"), (2, "", "y"), (3, None, None)], schema)
    target = frame(spark, [(1, "x", None), (2, None, "y"), (3, None, None)], schema)
    assert statuses(compare.compare_row_hash(source, target, ["k"])) == {1: "changed", 2: "changed", 3: "matched"}
    changed = {r["k"]: r["changed"] for r in compare.changed_columns(source, target, ["k"]).collect()}
    assert changed == {1: ["a", "b"], 2: ["a"]}


def test_equal_numbers_hash_alike(spark):
    source = frame(spark, [(1, "a", -0.0), (2, "b", float("nan"))])
    target = frame(spark, [(1, "a", 0.0), (2, "b", float("nan"))])
    assert set(statuses(compare.compare_row_hash(source, target, ["k"])).values()) == {"matched"}


def test_wider_types_of_a_copy_compare(spark):
    source = frame(spark, [(1, 5, 1.5), (2, None, None)], "k INT, n SMALLINT, x FLOAT")
    target = frame(spark, [(1, 5, 1.5), (2, None, None)], "k BIGINT, n BIGINT, x DOUBLE")
    assert set(statuses(compare.compare_row_hash(source, target, ["k"])).values()) == {"matched"}
    assert compare.changed_columns(source, target, ["k"]).count() == 0
    assert compare.compare_column_aggregates(source, target).filter("NOT matched").count() == 0
    required = target.select(F.coalesce("k", F.lit(0)).alias("k"), "n", "x")
    assert set(statuses(compare.compare_row_hash(source, required, ["k"])).values()) == {"matched"}


def test_maps_and_nested_values_compare(spark):
    schema = "k INT, m MAP<STRING,INT>, s STRUCT<a: DOUBLE, t: ARRAY<STRUCT<z: MAP<STRING,INT>>>>"
    source = frame(spark, [(1, {"a": 1, "b": 2}, (0.0, [({"x": 1},)])), (2, {"a": 1}, None)], schema)
    target = frame(spark, [(1, {"b": 2, "a": 1}, (-0.0, [({"x": 1},)])), (2, {"a": 2}, None)], schema)
    assert statuses(compare.compare_row_hash(source, target, ["k"])) == {1: "matched", 2: "changed"}
    assert compare.compare_column_aggregates(source, target).count() == 3


def test_copy_of_a_table_has_no_difference(spark):
    table = frame(spark, [(i % 7, f"n{i}", i / 4) for i in range(100)])
    assert compare.compare_row_count(table, table).first()["matched"]
    assert compare.compare_column_aggregates(table, table).filter("NOT matched").count() == 0
    assert compare.compare_row_bag(table, table.repartition(5)).filter("source_rows <> target_rows").count() == 0
    assert compare.bag_difference(table, table).count() == 0
    assert compare.partition_compare(table, table.repartition(3), F.col("k")).filter("NOT matched").count() == 0


def test_column_aggregates_with_nulls_and_estimates(spark):
    source = frame(spark, [(1, "a", 1.5), (2, None, None), (2, "b", 2.5)])
    target = frame(spark, [(1, "a", 1.5), (2, "a", 1.0)])
    rows = {r["column_name"]: r for r in compare.compare_column_aggregates(source, target).collect()}
    name, amount = rows["name"], rows["amount"]
    assert (name["source_non_null"], name["source_nulls"], name["source_distinct_values"]) == (2, 1, 2)
    assert (name["target_nulls"], name["target_distinct_values"], name["target_max_value"]) == (0, 1, "a")
    assert (amount["source_sum_value"], amount["source_mean_value"], amount["target_min_value"]) == (4.0, 2.0, "1.0")
    assert not name["matched"] and not amount["matched"]
    estimated = {r["column_name"]: r for r in compare.compare_column_aggregates(source, target, exact_distinct=False).collect()}
    assert estimated["name"]["source_distinct_values"] == 2
    assert estimated["k"]["matched"] is False


def test_empty_copies(spark):
    table = frame(spark, [(1, "a", 1.0)])
    empty = table.filter("k > 1")
    assert compare.compare_row_count(table, empty).first()["matched"] is False
    assert statuses(compare.compare_row_hash(empty, table, ["k"])) == {1: "extra"}
    assert compare.compare_row_hash(empty, empty, ["k"]).count() == 0


rows = st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["a", "b", None])), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows, rows)
def test_bags_against_counters(spark, left, right):
    source, target = (frame(spark, side, "k INT, v STRING") for side in (left, right))
    surplus = Counter(left) - Counter(right)
    lack = Counter(right) - Counter(left)
    got = {(r["k"], r["v"], r["side"]): r["copies"] for r in compare.bag_difference(source, target).collect()}
    assert got == {**{(*k, "source"): n for k, n in surplus.items()}, **{(*k, "target"): n for k, n in lack.items()}}
    common = {(r["k"], r["v"]): r["copies"] for r in compare.bag_intersection(source, target).collect()}
    assert common == dict(Counter(left) & Counter(right))


def test_tiers_decide_the_checks(spark):
    table = frame(spark, [(1, "a", 1.0), (2, "b", 2.0)])
    changed = frame(spark, [(1, "a", 1.0), (2, "c", 2.0)])
    swapped = frame(spark, [(1, "b", 1.0), (2, "a", 2.0)])
    pairs = [
        compare.TablePair("a", "same", table, table, "tier1", ["k"]),
        compare.TablePair("a", "changed", table, changed, "tier1", ["k"]),
        compare.TablePair("a", "swapped", table, swapped, "tier1"),
        compare.TablePair("a", "swapped2", table, swapped, "tier2"),
        compare.TablePair("a", "changed3", table, changed, "tier3"),
    ]
    got = {r["target_table"]: (r["status"], r["checks_passed"], r["checks_failed"]) for r in compare.tiered_validation(pairs).collect()}
    assert got == {
        "same": ("passed", "row_count,column_aggregates,row_hash", ""),
        "changed": ("failed", "row_count", "column_aggregates,row_hash"),
        "swapped": ("failed", "row_count,column_aggregates", "row_hash"),
        "swapped2": ("passed", "row_count,column_aggregates", ""),
        "changed3": ("passed", "row_count", ""),
    }
    report = {r["tier"]: r for r in compare.validation_report(compare.tiered_validation(pairs)).collect()}
    assert (report["tier1"]["tables_passed"], report["tier1"]["tables_failed"]) == (1, 2)


def test_kpi_tolerances(spark):
    kpis = frame(
        spark,
        [("users", 125000.0, 124850.0, 1.0), ("revenue", 2450000.5, 2450000.5, 0.01), ("length", 342.5, 340.1, 2.0),
         ("rate", 3.45, 3.42, 0.5), ("zero", 0.0, 0.0, 0.0), ("from zero", 0.0, 0.1, 50.0)],
        "name STRING, legacy_value DOUBLE, new_value DOUBLE, tolerance_pct DOUBLE",
    )
    got = {r["name"]: r["matched"] for r in compare.reconcile_kpis(kpis).collect()}
    assert got == {"users": True, "revenue": True, "length": True, "rate": False, "zero": True, "from zero": False}


def test_a_lost_column_fails(spark):
    source = frame(spark, [(1, "a", 1.0), (2, "b", 2.0)])
    lost = source.drop("amount")
    pairs = [
        compare.TablePair("a", "lost", source, lost, "tier1", ["k"]),
        compare.TablePair("a", "added", lost, source, "tier1", ["k"]),
        compare.TablePair("a", "cased", source, source.withColumnRenamed("amount", "AMOUNT"), "tier1", ["k"]),
        compare.TablePair("a", "cased and changed", source, frame(spark, [(1, "a", 1.0), (2, "b", 5.0)], "k INT, name STRING, Amount DOUBLE"), "tier1", ["k"]),
        compare.TablePair("a", "retyped", source, source.withColumn("amount", F.col("amount").cast("string")), "tier3"),
        compare.TablePair("a", "nothing shared", source, source.select(F.col("k").alias("z")), "tier2"),
    ]
    got = {r["target_table"]: (r["status"], r["checks_failed"], r["error"]) for r in compare.tiered_validation(pairs).collect()}
    assert got == {
        "lost": ("failed", "schema", None),
        "added": ("failed", "schema", None),
        "cased": ("passed", "", None),
        "cased and changed": ("failed", "column_aggregates,row_hash", None),
        "retyped": ("failed", "schema", None),
        "nothing shared": ("failed", "schema", None),
    }
    rows = {r["column_name"]: (r["status"], r["source_non_null"], r["target_non_null"]) for r in compare.compare_schema(source, lost).collect()}
    assert rows == {"k": ("same", 2, 2), "name": ("same", 2, 2), "amount": ("only_source", 2, None)}
    assert compare.schema_differences(source, source.withColumnRenamed("k", "K"), ignore_case=False)[0][3] == "only_source"


def test_a_broken_pair_is_a_row(spark):
    table = frame(spark, [(1, "a", 1.0)])
    gone = lambda: spark.read.parquet("/nowhere/at/all")
    got = compare.tiered_validation([compare.TablePair("a", "gone", table, gone, "tier1", ["k"]), compare.TablePair("a", "same", table, table, "tier2")])
    rows = {r["target_table"]: r for r in got.collect()}
    assert rows["gone"]["status"] == "failed" and "PATH_NOT_FOUND" in rows["gone"]["error"]
    assert rows["same"]["status"] == "passed" and rows["same"]["error"] is None


def test_sums_of_huge_and_special_values(spark):
    source = frame(spark, [(1, 1e23), (2, 1.0), (3, float("nan")), (4, float("inf")), (5, float("-inf")), (6, 1e300), (7, None), (8, 0.001)], "k INT, v DOUBLE")
    row = {r["column_name"]: r for r in compare.compare_column_aggregates(source, source).collect()}["v"]
    assert row["source_sum_value"] == 1e300
    assert (row["source_nan_values"], row["source_infinite_values"], row["source_overflow_values"]) == (1, 2, 0)
    assert row["source_mean_value"] == 1e300 / 4
    assert (row["source_non_null"], row["source_nulls"]) == (7, 1)
    small = frame(spark, [(1, float("nan")), (2, 1.0), (3, float("inf"))], "k INT, v DOUBLE")
    assert {r["column_name"]: r for r in compare.compare_column_aggregates(small, small).collect()}["v"]["source_mean_value"] == 1.0
    wide = frame(spark, [(1, 0.5)], "k INT, v DOUBLE").select("k", F.col("v").cast("decimal(38,18)").alias("v"))
    assert {r["column_name"]: r for r in compare.compare_column_aggregates(wide, wide).collect()}["v"]["source_sum_value"] == 0.5


def profile(spark, left, right=None):
    frames = [frame(spark, [(v,) for v in side], "v DOUBLE").repartition(3) for side in (left, left if right is None else right)]
    return compare.compare_column_aggregates(*frames).first()


def test_sums_see_every_double(spark):
    assert not profile(spark, [1e-13, 5e-13, 9e-13], [1e-13, 2e-13, 9e-13])["matched"]
    row = profile(spark, [1e300, 1e-300, -1e300, 2.5, 5e-324])
    assert row["matched"] and row["source_sum_value"] == 2.5
    assert not profile(spark, [1e300, 5e-324, -1e300], [1e300, 1e-323, -1e300])["matched"]
    assert profile(spark, [1.7e308, 1.7e308])["source_sum_value"] == float("inf")
    assert profile(spark, [1.7e308, 1.7e308, -1.7e308, -1.7e308, 1.0])["source_sum_value"] == 1.0
    assert profile(spark, [0.0, -0.0])["source_sum_value"] == 0.0 and profile(spark, [float("nan")])["source_sum_value"] is None
    assert profile(spark, [0.5, 0.5], [1.0, 0.0])["source_sum_value"] == 1.0


def test_a_large_table_of_large_values_equals_itself(spark):
    table = spark.range(1_300_000).select(F.lit(9e25).alias("v"))
    row = compare.compare_column_aggregates(table, table.repartition(5)).first()
    assert row["matched"] and row["source_sum_value"] == float(f"{1_300_000 * 9 * 10**25:.14e}")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=40))
def test_exact_sums(spark, values):
    want = sum(map(Fraction, values))
    try:
        want = float(f"{want.numerator / want.denominator:.14e}")
    except OverflowError:
        want = float("inf") if want > 0 else float("-inf")
    row = profile(spark, values, values[::-1])
    assert row["matched"] and row["source_sum_value"] == want


def test_validation_goes_on_from_its_journal(spark, tmp_path):
    opened, table = Counter(), frame(spark, [(1, "a", 1.0)])

    def copy(name, broken=False):
        def run():
            opened[name] += 1
            if broken:
                raise KeyboardInterrupt("the run is killed")
            return table

        return run

    named = lambda name, **kw: compare.TablePair("t", name, table, copy(name, **kw), "tier2")
    journal = str(tmp_path / "journal")
    with pytest.raises(KeyboardInterrupt):
        compare.tiered_validation([named("a"), named("b"), named("c", broken=True)], at_once=1, journal=journal)
    rows = compare.tiered_validation([named("a"), named("b"), named("c"), named("d")], at_once=1, journal=journal).collect()
    assert [(r["target_table"], r["status"]) for r in rows] == [(n, "passed") for n in "abcd"]
    assert opened == {"a": 1, "b": 1, "c": 2, "d": 1}
    gone = compare.TablePair("t", "gone", table, lambda: spark.read.parquet("/nowhere"), "tier3")
    assert compare.tiered_validation([gone], journal=journal).first()["status"] == "failed"
    again = compare.TablePair("t", "gone", table, copy("gone"), "tier3")
    assert compare.tiered_validation([again], journal=journal).first()["status"] == "passed"


def tree_rows(result):
    return {tuple(r)[:-1] for r in result.collect() if r["status"] != "matched" and not r["same_rows"]}


@pytest.mark.parametrize("keys", [["k"], ["name"], ["k", "name"]])
def test_tree_finds_what_the_plain_comparison_finds(spark, keys):
    rows = [(i * 3, f"n{i}", i / 4) for i in range(3000)] + [(None, None, 1.0)]
    source = frame(spark, rows)
    target = frame(spark, [(k, n, v + (k in (300, 303, 6000))) if k is not None else (None, None, 2.0) for k, n, v in rows if k != 1500] + [(9_999, "x", 1.0)])
    for leaf_rows in (0, 100, 10_000):
        found = key_tree.compare_by_tree(source, target, keys, fanout=8, leaf_rows=leaf_rows)
        assert tree_rows(found.rows) == tree_rows(compare.compare_row_hash(source, target, keys))
    found = key_tree.compare_by_tree(source, target, keys, fanout=8, leaf_rows=20)
    assert found.levels[0].rows_read == 6002 and found.levels[-1].unequal_rows < 400
    equal = key_tree.compare_by_tree(source, source.repartition(3), keys)
    assert [(x.level, x.unequal_nodes) for x in equal.levels] == [(0, 0)] and equal.rows.count() == 0
    empty = source.limit(0)
    assert key_tree.compare_by_tree(source, empty, keys, leaf_rows=500, fanout=4).rows.filter("status = 'missing'").count() == 3001
    assert key_tree.compare_by_tree(empty, empty, keys).rows.count() == 0


def test_duplicate_keys_copied_as_they_are(spark):
    table = frame(spark, [(1, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0)])
    other = frame(spark, [(1, "a", 1.0), (1, "b", 2.5), (2, "c", 3.0)])
    rows = {r["k"]: (r["status"], r["same_rows"]) for r in compare.compare_row_hash(table, table.repartition(3), ["k"]).collect()}
    assert rows == {1: ("duplicate_key", True), 2: ("matched", True)}
    assert {r["k"]: r["same_rows"] for r in compare.compare_row_hash(table, other, ["k"]).collect()} == {1: False, 2: True}
    got = compare.tiered_validation([compare.TablePair("a", "same", table, table, "tier1", ["k"]), compare.TablePair("a", "other", table, other, "tier1", ["k"])])
    assert {r["target_table"]: r["status"] for r in got.collect()} == {"same": "passed", "other": "failed"}


def test_no_raw_value_is_shuffled(spark):
    table = frame(spark, [(1, "a", 1.0)])
    plan = compare.compare_column_aggregates(table, table)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "hashpartitioning" in line:
            assert "name" not in line and "amount" not in line


def test_each_copy_counts_its_distinct_values_alone(spark):
    table = frame(spark, [(1, "a", 1.0), (1, None, -0.0), (None, "b", 0.0)])
    other = frame(spark, [(1, None, 1.0), (2, None, float("nan"))])
    result = compare.compare_column_aggregates(table, other)
    plan = result._jdf.queryExecution().executedPlan().toString()
    # an exchange for each copy: no union lies between reading and the aggregate before the shuffle
    assert len(re.findall(r"Exchange hashpartitioning\(column#\d+, h#", plan)) == 2
    assert {r["column_name"]: (r["source_distinct_values"], r["target_distinct_values"]) for r in result.collect()} == {"k": (1, 2), "name": (2, 0), "amount": (2, 2)}
