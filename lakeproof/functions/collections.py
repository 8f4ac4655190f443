"""Array and map functions whose semantics in the source dialect differ from Spark's; the others are Spark's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_transform_cast(arr: Column, dtype: str) -> Column:
    return F.transform(arr, lambda e: e.cast(dtype))


def array_max(arr: Column) -> Column:
    """NULL if an element is NULL (Spark's own skips it)."""
    return F.when(~F.exists(arr, lambda e: e.isNull()), F.array_max(arr))


def array_min(arr: Column) -> Column:
    """NULL if an element is NULL (Spark's own skips it)."""
    return F.when(~F.exists(arr, lambda e: e.isNull()), F.array_min(arr))


def element_at(arr: Column, index: int) -> Column:
    """1-based; NULL out of range."""
    return F.try_element_at(arr, F.lit(index))


def empty_map(key_type: str = "string", value_type: str = "int") -> Column:
    return F.create_map().cast(f"map<{key_type},{value_type}>")


def map_concat(first: Column, *others: Column) -> Column:
    """The last map wins on equal keys (Spark's own raises)."""

    def absent_from(other: Column) -> Callable[[Column, Column], Column]:
        return lambda k, _v: ~F.map_contains_key(other, k)

    out = first
    for other in others:
        out = F.map_concat(F.map_filter(out, absent_from(other)), other)
    return out
