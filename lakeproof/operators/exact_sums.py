"""Exact sums of doubles, whatever their order and range, from BIGINT sums.

A finite double is written in digits to the base 2^22: its leading digit's position is its bin, and it has at most four digits
from there down, as a double holds 53 bits. Digits are summed by bin as BIGINT, which holds 2^41 of them. The sums of all bins, shifted by their
positions, are the digits of the exact sum. They are put together as one long integer per column in the end, from a row per bin: there are
less than a hundred bins, however many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 22
DIGITS = 4
#: Below the smallest position of a digit: doubles are multiples of 2^-1074.
BOTTOM = -50 - DIGITS
NAMES = [f"d{j}" for j in range(DIGITS)]


def with_digits(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with the column bin and the signed digits d0 to d3 of the finite doubles in a column; zeros add nothing and are left out.

    The bin is found by a logarithm, and a neighbouring one would do as well. Scaling by powers of two, in two steps, and
    cutting are exact.
    """
    out = rows.withColumn("bin", F.expr(f"CAST(floor(log2(abs({value})) / {BITS}) AS INT)")).filter("bin IS NOT NULL")
    out = out.withColumn("scale", F.expr(f"pow(2.0D, bin * -{BITS // 2})")).withColumn("r0", F.expr(f"{value} * scale * scale"))
    for j in range(DIGITS):
        out = out.withColumn(f"d{j}", F.expr(f"CAST(r{j} AS BIGINT)")).withColumn(f"r{j + 1}", F.expr(f"(r{j} - d{j}) * {1 << BITS}"))
    return out


def exact(bins: list[dict] | None) -> int:
    """The exact sum of (bin, d0 .. d3) rows, in units of 2^(22 * ``BOTTOM``)."""
    return sum(row[name] << BITS * (row["bin"] - j - BOTTOM) for row in bins or () for j, name in enumerate(NAMES))


def as_double(total: int) -> float:
    """The sum rounded to 15 significant decimal digits, which is what a double holds of any decimal number."""
    try:
        value = total / (1 << -BITS * BOTTOM)  # rounded once, to the nearest double
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")
    return float(f"{value:.14e}")


COMPARED = "column int, exact_sum_0 double, exact_sum_1 double, same_sum boolean"


def compare_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (column, bins_0, bins_1), a row per column, to ``COMPARED``."""
    for batch in batches:
        sums = [[exact(bins) for bins in batch.column(side).to_pylist()] for side in (1, 2)]
        doubles = [pa.array([as_double(x) for x in side], pa.float64()) for side in sums]
        same = pa.array([a == b for a, b in zip(*sums, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), *doubles, same], names=[c.split()[0] for c in COMPARED.split(", ")])
