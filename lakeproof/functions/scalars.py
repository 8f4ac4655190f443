"""Casts, conditionals, JSON, bit and number functions with the semantics of the source dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def try_cast(c: Column, dtype: str) -> Column:
    return c.try_cast(dtype)


def cast_varchar(c: Column, length: int | None = None) -> Column:
    text = c.cast("string")
    return text if length is None else F.substring(text, 1, length)


def _rounded(c: Column, dtype: str) -> Column:
    """Numbers with a fraction are rounded half away from zero (Spark's own cast cuts the fraction off)."""
    kind = F.typeof(c)
    fraction = kind.isin("float", "double") | kind.startswith("decimal")
    exact = c.cast("string").try_cast("decimal(38,18)")
    # beyond that precision, and for NaN, the plain cast decides: it raises where the value does not fit
    return F.when(fraction & exact.isNotNull(), F.round(exact, 0).cast(dtype)).otherwise(c.cast(dtype))


def cast_integer(c: Column) -> Column:
    return _rounded(c, "int")


def cast_bigint(c: Column) -> Column:
    return _rounded(c, "bigint")


def cast_double(c: Column) -> Column:
    return c.cast("double")


def cast_real(c: Column) -> Column:
    return c.cast("float")


def cast_boolean(c: Column) -> Column:
    return c.cast("boolean")


def cast_tinyint(c: Column) -> Column:
    return _rounded(c, "tinyint")


def cast_smallint(c: Column) -> Column:
    return _rounded(c, "smallint")


def cast_varbinary(c: Column) -> Column:
    return c.cast("binary")


# Spark has no TRY around any expression; the failing operations have NULL-returning twins.
try_divide = F.try_divide
try_add = F.try_add
try_subtract = F.try_subtract
try_multiply = F.try_multiply


def nvl(c: Column, default: Column) -> Column:
    return F.nvl(c, default)


def nvl2(c: Column, present: Column, absent: Column) -> Column:
    return F.nvl2(c, present, absent)


def if_(condition: Column, yes, no=None) -> Column:
    return F.when(condition, yes).otherwise(no)


def json_extract(j: Column, path: str) -> Column:
    """JSON text of the value at the path."""
    return F.to_json(F.try_variant_get(F.try_parse_json(j), path, "variant"))


def json_extract_scalar(j: Column, path: str) -> Column:
    """Text of a scalar; NULL for objects and arrays."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(j), path, "variant"))
    return F.when(~F.coalesce(kind.rlike("^(OBJECT|ARRAY)"), F.lit(False)), F.get_json_object(j, path))


def json_array_length(j: Column) -> Column:
    return F.json_array_length(j)


def json_parse(j: Column) -> Column:
    """VARIANT; NULL where the text is not JSON."""
    return F.try_parse_json(j)


def json_format(v: Column) -> Column:
    return F.to_json(v)


def json_array_get(j: Column, index: int) -> Column:
    """JSON text of an element, counted from 0, or from the end if negative; NULL out of range."""
    if index >= 0:
        return F.get_json_object(j, f"$[{int(index)}]")
    at = F.json_array_length(j) + int(index)
    path = F.concat(F.lit("$["), at.cast("string"), F.lit("]"))
    return F.when(at >= 0, F.call_function("get_json_object", j, path))


def bitwise_and(a: Column, b) -> Column:
    return a.bitwiseAND(b)


def bitwise_or(a: Column, b) -> Column:
    return a.bitwiseOR(b)


def bitwise_xor(a: Column, b) -> Column:
    return a.bitwiseXOR(b)


def bitwise_not(a: Column) -> Column:
    return F.bitwise_not(a)


def bit_count(a: Column, bits: int = 64) -> Column:
    """Set bits of the two's complement in the given width."""
    if bits >= 64:
        return F.bit_count(a)
    return F.bit_count(a.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")))


def infinity() -> Column:
    return F.lit(float("inf"))


def nan() -> Column:
    return F.lit(float("nan"))


def is_nan(x: Column) -> Column:
    return F.isnan(x)


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def truncate(x: Column) -> Column:
    """Toward zero, without a negative zero; from 2^53 on, doubles are whole."""
    wide = x.cast("double")
    return F.when(F.abs(wide) >= 2.0**53, wide).otherwise(F.when(x < 0, -F.floor(-x)).otherwise(F.floor(x)).cast("double"))


def random(seed: int | None = None) -> Column:
    return F.rand(seed)


def to_base(x: Column, radix: int) -> Column:
    """Digits of a whole number in a radix from 2 to 36, with a minus sign if negative."""
    digits = F.lower(F.conv(F.abs(x.cast("decimal(20,0)")).cast("string"), 10, radix))
    return F.concat(F.when(x < 0, "-").otherwise(""), digits)


def mod(a: Column, b) -> Column:
    return a % b


def cbrt(x: Column) -> Column:
    return F.cbrt(x)


def log2(x: Column) -> Column:
    """-Infinity at 0 and NaN below (Spark's own gives NULL)."""
    return F.when(x > 0, F.log2(x)).when(x == 0, float("-inf")).when(x < 0, float("nan"))
