"""Order-insensitive fingerprints of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def carrier(dtype: T.DataType) -> T.DataType:
    """The type a column is compared in: a copy may hold integers or floats in a wider type."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    return dtype


def comparable(df: DataFrame, column: str) -> Column:
    dtype = carrier(df.schema[column].dataType)
    return canonical(df[column].cast(dtype), dtype)


def canonical(col: Column, dtype: T.DataType) -> Column:
    """Give equal values equal bytes: one zero, one NaN, maps as sorted entries."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(col), F.lit(float("nan")).cast(dtype)).otherwise(col + F.lit(0.0).cast(dtype))
    if isinstance(dtype, T.MapType):
        entry = T.StructType([T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)])
        return F.array_sort(F.transform(F.map_entries(col), lambda e: canonical(e, entry)))
    if isinstance(dtype, T.ArrayType) and _needs_canonical(dtype.elementType):
        return F.transform(col, lambda e: canonical(e, dtype.elementType))
    if isinstance(dtype, T.StructType) and _needs_canonical(dtype):
        fields = [canonical(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.VariantType):
        return F.to_json(col)
    return col


def _needs_canonical(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.MapType, T.VariantType)):
        return True
    if isinstance(dtype, T.ArrayType):
        return _needs_canonical(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_needs_canonical(f.dataType) for f in dtype.fields)
    return False


def _parts(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    values = [comparable(df, c) for c in columns]
    # xxhash64 skips nulls, so (NULL, 'a') and ('a', NULL) collide without these flags
    flags = [df[c].isNull() for c in columns]
    return values + flags


def row_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """64-bit row fingerprint; enough where it is compared under one key."""
    return F.xxhash64(*_parts(df, columns))


def row_hash_pair(df: DataFrame, columns: Sequence[str]) -> tuple[Column, Column]:
    """Two independent fingerprints; 128 bits where rows are grouped by fingerprint across a whole table."""
    parts = _parts(df, columns)
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)


def cell_hash(df: DataFrame, column: str) -> Column:
    return F.when(df[column].isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(comparable(df, column)))


def checksum_aggregates(h: Column, when: Column | None = None, prefix: str = "") -> list[Column]:
    """Order-insensitive table fingerprint from a row hash.

    XOR alone cancels pairs, so count and three partial sums (22, 22 and 20 bits of the hash) go along;
    the parts stay in BIGINT up to 2^41 rows per group.
    """
    pick = (lambda c: c) if when is None else (lambda c: F.when(when, c))
    mask = 0x3FFFFF
    return [
        F.count(pick(h)).alias(f"{prefix}rows"),
        F.bit_xor(pick(h)).alias(f"{prefix}xor"),
        F.sum(pick(h.bitwiseAND(mask))).alias(f"{prefix}sum_low"),
        F.sum(pick(F.shiftrightunsigned(h, 22).bitwiseAND(mask))).alias(f"{prefix}sum_mid"),
        F.sum(pick(F.shiftrightunsigned(h, 44))).alias(f"{prefix}sum_high"),
    ]
