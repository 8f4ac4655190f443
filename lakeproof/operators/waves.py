"""Migration waves: one per line of business."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeproof.functions.windows import HOT_ROWS, ranked
from lakeproof.operators.inventory import TABLE_KEY, assign_lob
from lakeproof.session import materialize

# Planning rule of ten days for every fifty tables begun, at least ten.
TABLES_PER_STEP = 50
DAYS_PER_STEP = 10


def _waves(counts: DataFrame, max_parallel: int, plans: Sequence[str]) -> DataFrame:
    # one row per plan and line of business, a configured list, so the window is bounded
    number = F.row_number().over(Window.partitionBy(*plans).orderBy("lob"))
    days = F.greatest(F.lit(DAYS_PER_STEP), F.ceil(F.col("table_count") / TABLES_PER_STEP) * DAYS_PER_STEP)
    return counts.withColumn("wave", number).select(
        *plans,
        "lob",
        F.concat(F.lit("wave-"), F.col("wave").cast("string")).alias("wave_id"),
        F.concat(F.lit("Wave "), F.col("wave").cast("string")).alias("name"),
        "table_count",
        days.cast("bigint").alias("estimated_days"),
        F.floor((F.col("wave") - 1) / max_parallel).cast("bigint").alias("parallel_group"),
    )


def plan_waves(
    classifications: DataFrame,
    lobs: Sequence[str],
    max_parallel: int = 3,
    position: str = "position",
    hot_rows: int = HOT_ROWS,
    plans: Sequence[str] = (),
) -> DataFrame:
    """One row per table: its wave and its place in it (tier 1 first, then input position).

    Columns that name a table beside ``table_name`` (its database) are carried along, so tables of equal names stay apart.
    ``plans`` names columns, such as an inventory's id, whose values are planned each by itself.
    Long form rather than one array per wave: a line of business may own most tables. Lines of more than
    ``hot_rows`` tables are ranked in ranges of as many input positions, so no task sorts such a line.
    """
    plans = list(plans)
    tier = F.when(F.col("tier") == "TIER_1", 0).when(F.col("tier") == "TIER_2", 1).when(F.col("tier") == "TIER_3", 2)
    keys = [c for c in TABLE_KEY if c in classifications.columns and c not in plans]
    assigned = assign_lob(classifications, lobs).select(
        *plans, *keys, "tier", position, "lob", F.coalesce(tier, F.lit(99)).alias("__tier")
    )
    # counted and ranked below: written once, so that classifications are not worked out for each use
    tables = materialize(assigned)
    waves = _waves(tables.groupBy(*plans, "lob").agg(F.count("*").alias("table_count")), max_parallel, plans)
    bucket = F.struct("__tier", F.floor(F.col(position) / hot_rows).alias("part"))
    placed = ranked(tables, [*plans, "lob"], ["__tier", position], bucket, hot_rows)
    joined = placed.join(waves.withColumnsRenamed({c: f"__{c}" for c in (*plans, "lob")}), _same([*plans, "lob"]))
    return joined.select(
        *plans, "wave_id", "name", "lob", F.col("__row_number").alias("place"), *keys, "tier", "estimated_days", "parallel_group"
    )


def _same(columns: Sequence[str]) -> Column:
    """Equal to the renamed columns of the other side; NULL is a plan like any other."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])


def wave_plan_report(
    classifications: DataFrame, lobs: Sequence[str], max_parallel: int = 3, plans: Sequence[str] = ()
) -> DataFrame:
    """One row per wave, with the totals of the plan."""
    plans = list(plans)
    counts = assign_lob(classifications, lobs).groupBy(*plans, "lob").agg(F.count("*").alias("table_count"))
    everything = Window.partitionBy(*plans)
    return _waves(counts, max_parallel, plans).select(
        *plans,
        "wave_id",
        "name",
        "lob",
        "table_count",
        "estimated_days",
        "parallel_group",
        F.count("*").over(everything).alias("total_waves"),
        F.sum("table_count").over(everything).alias("total_tables"),
    )
