"""Stored sketches of a table's columns, per partition of the table: distinct values (theta) and quantiles (KLL).

A sketch is taken once, when a partition is written, and is a few kilobytes whatever the partition holds. Later it is merged
over partitions and held against the sketch of a copy, without reading the old table again. That gives what two counts of
distinct values cannot: how many values are on one side only.

The standard error of a distinct count is its value / sqrt(2^``LG_ENTRIES``), and that of a difference is the same share of the values
of both sides. Up to 2^``LG_ENTRIES`` distinct values, all figures are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeproof.operators.hashing import canonical, carrier

LG_ENTRIES = 14
#: Quantiles that are compared, and how far a KLL rank may be off.
QUANTILES = (0.25, 0.5, 0.75)
RANK_ERROR = 0.02
_NUMBERS = (T.LongType, T.DoubleType, T.DecimalType)


def sketch_columns(df: DataFrame, columns: Sequence[str], partition: Column | None = None, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """(partition_value, column_name, non_null, distinct_sketch, quantile_sketch): one aggregate, a row per task and partition shuffled.

    Equal values of types of other widths are equal. Columns that are no numbers have no quantile sketch; NaN counts
    as a value, and is left out of quantiles.
    """
    value = F.lit("") if partition is None else partition.cast("string")
    cells = []
    for c in columns:
        kind = carrier(df.schema[c].dataType)
        number = F.lit(None).cast("binary")
        if isinstance(kind, _NUMBERS):
            double = df[c].cast("double")
            number = F.kll_sketch_agg_double(F.when(~F.isnan(double), double))
        hashed = F.when(df[c].isNotNull(), F.xxhash64(canonical(df[c].cast(kind), kind)))
        cells.append(F.struct(F.lit(c).alias("column_name"), F.count(df[c]).alias("non_null"), F.theta_sketch_agg(hashed, lg_entries).alias("distinct_sketch"), number.alias("quantile_sketch")))
    return df.groupBy(value.alias("partition_value")).agg(F.array(*cells).alias("cells")).select("partition_value", F.inline("cells"))


SCHEMA = "column_name string, non_null bigint, distinct_sketch binary, quantile_sketch binary, partition_value string"


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Store sketches; those of partitions that are there already are replaced, the others stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partition_value").parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def merged(sketches: DataFrame, by: Sequence[str] = ("column_name",), lg_entries: int = LG_ENTRIES) -> DataFrame:
    """Sketches united over partitions."""
    return sketches.groupBy(*by).agg(
        F.sum("non_null").alias("non_null"),
        F.theta_union_agg("distinct_sketch", lg_entries).alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )


def sketch_differences(source: DataFrame, target: DataFrame, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """Per column of two tables' sketches: distinct values of either side and on one side only, their standard error, and quantiles.

    A column that one side lacks has all its values on the other.
    """
    sides = [
        merged(side, lg_entries=lg_entries).select("column_name", *[F.col(c).alias(f"{name}_{c}") for c in ("non_null", "distinct_sketch", "quantile_sketch")])
        for name, side in (("source", source), ("target", target))
    ]
    both = sides[0].join(sides[1], "column_name", "full")
    s, t = F.col("source_distinct_sketch"), F.col("target_distinct_sketch")
    count = lambda sketch: F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0).cast("bigint"))
    only = lambda a, b: F.when(b.isNull(), count(a)).when(a.isNull(), F.lit(0)).otherwise(count(F.theta_difference(a, b)))
    ends = [F.when(F.col(f"{side}_quantile_sketch").isNotNull() & (F.kll_sketch_get_n_double(f"{side}_quantile_sketch") > 0), F.array(*[F.kll_sketch_get_quantile_double(f"{side}_quantile_sketch", F.lit(q)) for q in QUANTILES])).alias(f"{side}_quantiles") for side in ("source", "target")]
    out = both.select(
        "column_name", F.coalesce("source_non_null", F.lit(0)).alias("source_non_null"), F.coalesce("target_non_null", F.lit(0)).alias("target_non_null"),
        count(s).alias("source_distinct"), count(t).alias("target_distinct"), only(s, t).alias("only_source"), only(t, s).alias("only_target"), *ends,
    )
    every = F.greatest("source_distinct", "target_distinct") + F.least("only_source", "only_target")
    # below the size of a sketch nothing was sampled
    return out.withColumn("standard_error", F.when(every < 1 << lg_entries, F.lit(0.0)).otherwise(every / float(2 ** (lg_entries / 2))))
