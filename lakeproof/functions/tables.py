"""Table functions: unnesting, inline values and lateral subqueries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, arr: Column, name: str) -> DataFrame:
    return df.select("*", F.explode(arr).alias(name))


def unnest_with_ordinality(df: DataFrame, arr: Column, name: str, ordinal: str = "ord") -> DataFrame:
    """Ordinals start at 1."""
    return df.select("*", F.posexplode(arr).alias(ordinal, name)).withColumn(ordinal, F.col(ordinal) + 1)


def values(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """An inline table, as a DataFrame of the same session."""
    return df.sparkSession.createDataFrame(list(rows), schema)


def lateral(df: DataFrame, subquery: DataFrame) -> DataFrame:
    """Comma join with a correlated subquery; refer to the left side with ``col.outer()``."""
    return df.lateralJoin(subquery)
