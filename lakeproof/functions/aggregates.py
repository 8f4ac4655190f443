"""Aggregate functions with the semantics of the source dialect.

Those that build maps or lists take a DataFrame: they first aggregate per key, so that map-side combining
shrinks repeated keys, and only then build one collection per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.operators.hashing import checksum_aggregates


def approx_distinct(c: Column, rsd: float = 0.023) -> Column:
    """HyperLogLog++ with the source dialect's default standard error."""
    return F.approx_count_distinct(c, rsd)


def approx_percentile(c: Column, p: float, accuracy: int = 10000) -> Column:
    return F.approx_percentile(c, p, accuracy)


def arbitrary(c: Column) -> Column:
    return F.any_value(c)


def bool_and(c: Column) -> Column:
    return F.bool_and(c)


def bool_or(c: Column) -> Column:
    return F.bool_or(c)


def every(c: Column) -> Column:
    return F.every(c)


def count_if(c: Column) -> Column:
    return F.count_if(c)


def count_star_filter(c: Column) -> Column:
    return F.count_if(c)


def max_by(value: Column, order: Column) -> Column:
    return F.max_by(value, order)


def min_by(value: Column, order: Column) -> Column:
    return F.min_by(value, order)


def histogram(df: DataFrame, group: Sequence[str], column: str) -> DataFrame:
    """Exact value -> count map per group."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(column).alias("key"), F.col("n").alias("value"))))
    return counts.groupBy(*group).agg(F.map_from_entries(entries).alias("histogram"))


def map_agg(df: DataFrame, group: Sequence[str], key: str, value: str) -> DataFrame:
    """Key -> value map per group; of several values of a key the smallest is taken."""
    single = df.filter(F.col(key).isNotNull()).groupBy(*group, key).agg(F.min(value).alias("value"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), "value")))
    return single.groupBy(*group).agg(F.map_from_entries(entries).alias("map"))


def multimap_agg(df: DataFrame, group: Sequence[str], key: str, value: str) -> DataFrame:
    """Key -> list of values (sorted) per group."""
    lists = df.filter(F.col(key).isNotNull()).groupBy(*group, key).agg(
        F.array_sort(F.collect_list(value)).alias("value")
    )
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), "value")))
    return lists.groupBy(*group).agg(F.map_from_entries(entries).alias("map"))


def checksum(c: Column) -> list[Column]:
    """Order-insensitive fingerprint columns of a value."""
    return checksum_aggregates(F.xxhash64(c, c.isNull()))
