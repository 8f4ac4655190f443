"""Transfer prices and money as columns."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bound of each band in GiB and its price in USD per GiB; the last band is open.
BYTES_PER_GB = 1_073_741_824
EGRESS_BANDS = (
    (1, Decimal("0")),
    (10_240, Decimal("0.109")),
    (51_200, Decimal("0.085")),
    (153_600, Decimal("0.082")),
    (None, Decimal("0.080")),
)
OPTIMIZED_SHARE = Decimal("0.70")


def egress_cost(size_bytes: Column) -> Column:
    """Graduated price of a transfer as DECIMAL with 12 decimals; exact up to the final division."""
    size = size_bytes.cast("decimal(20,0)")
    parts, low = [], 0
    for high_gb, rate in EGRESS_BANDS:
        within = size if high_gb is None else F.least(size, F.lit(Decimal(high_gb * BYTES_PER_GB)).cast("decimal(20,0)"))
        in_band = F.greatest(within - F.lit(Decimal(low)).cast("decimal(20,0)"), F.lit(Decimal(0)))
        if rate:
            # bytes times price in thousandths is a whole number
            parts.append(in_band * F.lit(int(rate * 1000)))
        low = (high_gb or 0) * BYTES_PER_GB
    thousandths = reduce(lambda a, b: a + b, parts).cast("decimal(26,0)")
    return (thousandths / F.lit(Decimal(BYTES_PER_GB * 1000)).cast("decimal(14,0)")).cast("decimal(38,12)")


def with_credits(cost: Column, credit_pct: Column) -> Column:
    pct = credit_pct.cast("decimal(9,6)")
    return (cost - cost.cast("decimal(26,12)") * pct / 100).cast("decimal(38,12)")


def egress_with_credits(size_bytes: Column, credit_pct: Column) -> Column:
    return with_credits(egress_cost(size_bytes), credit_pct)


def egress_scenarios(df: DataFrame, size: str, credit_pct: Column) -> DataFrame:
    """Base price, with credits, and with credits on 70 % of the size; a negative size is an error."""
    bytes_ = F.when(F.col(size) < 0, F.raise_error(F.lit(f"{size} must be >= 0"))).otherwise(F.col(size)).cast("bigint")
    optimized = F.floor(bytes_.cast("decimal(20,0)") * F.lit(OPTIMIZED_SHARE)).cast("bigint")
    return df.select(
        "*",
        egress_cost(bytes_).alias("scenario_base_usd"),
        egress_with_credits(bytes_, credit_pct).alias("scenario_with_credits_usd"),
        egress_with_credits(optimized, credit_pct).alias("scenario_optimized_usd"),
    )


def money_sum(df: DataFrame, group: Sequence[str], amount: str = "amount", currency: str = "currency") -> DataFrame:
    """Sums within one currency: the currency is always part of the group."""
    return df.groupBy(*group, currency).agg(F.sum(F.col(amount).cast("decimal(28,6)")).cast("decimal(38,6)").alias(amount))


def single_currency_total(
    df: DataFrame, group: Sequence[str], amount: str = "amount", currency: str = "currency"
) -> DataFrame:
    """One sum per group; raises where a group mixes currencies."""
    low, high = F.min(currency), F.max(currency)
    totals = df.groupBy(*group).agg(
        low.alias("__low"), high.alias("__high"),
        F.sum(F.col(amount).cast("decimal(28,6)")).cast("decimal(38,6)").alias(amount),
    )
    mixed = F.raise_error(F.concat(F.lit("Currency mismatch: "), F.col("__low"), F.lit(" vs "), F.col("__high")))
    guarded = F.when(F.col("__low") != F.col("__high"), mixed).otherwise(F.col("__low"))
    return totals.select(*group, amount, guarded.alias(currency))


def money_difference(amount: Column, currency: Column, other: Column, other_currency: Column) -> Column:
    """``amount - other`` as DECIMAL; raises where the currencies differ."""
    mixed = F.raise_error(F.concat(F.lit("Currency mismatch: "), currency, F.lit(" vs "), other_currency))
    left = amount.cast("decimal(28,6)")
    difference = (left - other.cast("decimal(28,6)")).cast("decimal(38,6)")
    return F.when(currency != other_currency, mixed.cast("decimal(38,6)")).otherwise(difference)
