"""Lookups and joins between rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Permission of the old catalog and role of the new one.
PERMISSION_ROLES = {
    "SELECT": "roles/bigquery.dataViewer",
    "INSERT": "roles/bigquery.dataEditor",
    "UPDATE": "roles/bigquery.dataEditor",
    "DELETE": "roles/bigquery.dataEditor",
    "ALL": "roles/bigquery.dataOwner",
}
DEFAULT_ROLE = "roles/bigquery.dataViewer"


def permission_table(df: DataFrame) -> DataFrame:
    """The role table as a DataFrame; five rows, so it is safe to broadcast."""
    return df.sparkSession.createDataFrame(list(PERMISSION_ROLES.items()), "permission string, role string")


def permission_lookup(policies: DataFrame, roles: DataFrame, default: str = DEFAULT_ROLE) -> DataFrame:
    """Left join to a role table; is_default marks permissions that are not listed."""
    return policies.join(roles, "permission", "left").select(
        *policies.columns,
        F.coalesce("role", F.lit(default)).alias("role"),
        F.col("role").isNull().alias("is_default"),
    )


def map_permissions(policies: DataFrame) -> DataFrame:
    """Role per (permission, resource, principal); missing fields read as empty or 'unknown'."""
    named = policies.select(
        F.upper(F.coalesce("permission", F.lit(""))).alias("permission"),
        F.coalesce("resource", F.lit("unknown")).alias("resource"),
        F.coalesce("principal", F.lit("unknown")).alias("principal"),
    )
    return permission_lookup(named, permission_table(policies))


def text_lookup(paths: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Text per path; a missing one is empty."""
    return paths.join(texts.select(key, text), key, "left").withColumn(text, F.coalesce(text, F.lit("")))


def key_compare(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which copy holds each key and how often: a full outer join of per-key counts.

    Counting first leaves one row per key and side, so a hot key cannot multiply in the join.
    """
    keys = list(keys)
    left = source.groupBy(*keys).agg(F.count("*").alias("source_rows"))
    right = target.groupBy(*keys).agg(F.count("*").alias("target_rows"))
    joined = left.join(right, keys, "full_outer").fillna(0, ["source_rows", "target_rows"])
    presence = (
        F.when(F.col("target_rows") == 0, "source_only").when(F.col("source_rows") == 0, "target_only").otherwise("both")
    )
    return joined.withColumn("presence", presence)


def case_insensitive_equal(a: Column, b: Column) -> Column:
    return F.upper(a) == F.upper(b)


def case_insensitive_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equi join on upper-cased keys, so that it stays a hash or merge join."""
    return left.join(right, F.upper(left[left_key]) == F.upper(right[right_key]), how)


def unnest_join(df: DataFrame, arr: Column, name: str, keep_empty: bool = False) -> DataFrame:
    return df.select("*", (F.explode_outer if keep_empty else F.explode)(arr).alias(name))


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def ordered_limit(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """Top rows: each task keeps n, then the driver-side merge keeps n."""
    return df.orderBy(*order).limit(n)
