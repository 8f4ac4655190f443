from __future__ import annotations

import shutil

from pyspark.sql import functions as F

from lakeproof.operators import sketches

SCHEMA = "k INT, name STRING, amount DOUBLE, day STRING"


def rows(start, stop):
    return [(i, f"n{i % 500}", i / 8, f"d{i % 5}") for i in range(start, stop)]


def by_column(result):
    return {r["column_name"]: r for r in result.collect()}


def test_differences_of_stored_sketches(spark, tmp_path):
    source, target = (spark.createDataFrame(rows(*ends), SCHEMA) for ends in ((0, 3000), (200, 3100)))
    paths = []
    for name, df in (("source", source), ("target", target)):
        paths.append(str(tmp_path / name))
        sketches.write_sketches(sketches.sketch_columns(df, ["k", "name", "amount"], F.col("day")), paths[-1])
    found = by_column(sketches.sketch_differences(*[sketches.read_sketches(spark, p) for p in paths]))
    assert {c: (r["source_distinct"], r["target_distinct"], r["only_source"], r["only_target"], r["standard_error"]) for c, r in found.items()} == {
        "k": (3000, 2900, 200, 100, 0.0), "name": (500, 500, 0, 0, 0.0), "amount": (3000, 2900, 200, 100, 0.0),
    }
    assert found["name"]["source_quantiles"] is None
    assert all(abs(q - p * 3000) < 3000 * sketches.RANK_ERROR for q, p in zip(found["k"]["source_quantiles"], sketches.QUANTILES, strict=True))


def test_a_partition_that_is_written_again_is_replaced(spark, tmp_path):
    path = str(tmp_path / "sketches")
    df = spark.createDataFrame(rows(0, 100), SCHEMA)
    sketches.write_sketches(sketches.sketch_columns(df, ["k"], F.col("day")), path)
    sketches.write_sketches(sketches.sketch_columns(df.filter("day = 'd1' AND k < 50"), ["k"], F.col("day")), path)
    held = {r["partition_value"]: r["non_null"] for r in sketches.read_sketches(spark, path).collect()}
    assert held == {"d0": 20, "d1": 10, "d2": 20, "d3": 20, "d4": 20}
    shutil.rmtree(path)


def test_estimates_and_odd_values(spark):
    large = spark.range(200_000).select((F.col("id") * 7919).alias("v"))
    other = large.filter("v % 10 <> 0")
    r = by_column(sketches.sketch_differences(sketches.sketch_columns(large, ["v"]), sketches.sketch_columns(other, ["v"])))["v"]
    exact = large.count() - other.count()
    assert 0 < r["standard_error"] < 2_000 and abs(r["only_source"] - exact) <= 4 * r["standard_error"] and r["only_target"] == 0
    odd = spark.createDataFrame([(float("nan"),), (0.0,), (-0.0,), (None,), (float("nan"),)], "v DOUBLE")
    r = by_column(sketches.sketch_differences(sketches.sketch_columns(odd, ["v"]), sketches.sketch_columns(odd.limit(0), ["v"])))["v"]
    assert (r["source_non_null"], r["source_distinct"], r["only_source"], r["target_distinct"], r["target_quantiles"]) == (4, 2, 2, 0, None)
    wide = sketches.sketch_columns(spark.range(10).select(F.col("id").cast("int").alias("v")), ["v"])
    r = by_column(sketches.sketch_differences(wide, sketches.sketch_columns(spark.range(10).withColumnRenamed("id", "v"), ["v"])))["v"]
    assert (r["only_source"], r["only_target"]) == (0, 0)
