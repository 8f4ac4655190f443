"""Comparison of two copies of a table.

Both copies are tagged, unioned and grouped once. That shuffles each row a single time as a few bytes
(key and fingerprints), lets map-side aggregation collapse hot keys before the shuffle, and needs no join,
so one key holding a third of the rows costs one partial-aggregate row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeproof.operators import exact_sums
from lakeproof.operators.hashing import (
    canonical,
    carrier,
    cell_hash,
    checksum_aggregates,
    row_hash,
    row_hash_pair,
)

_SIDE = "__side"
_SOURCE, _TARGET = 0, 1


def _is(side: int) -> Column:
    return F.col(_SIDE) == side


def _count(side: int) -> Column:
    return F.count_if(_is(side))


def _aligned(
    source: DataFrame, target: DataFrame, columns: Sequence[str] | None, ignore_case: bool = True
) -> tuple[DataFrame, list[str]]:
    """The target with its columns named as in the source, and the columns to compare.

    Without ``columns`` these are all that both copies have in types that can be compared; what is left out is a finding
    of ``compare_schema``. A listed column that one copy lacks is an error.
    """
    named = {_folded(c, ignore_case): c for c in target.columns}
    renamed = {named[_folded(c, ignore_case)]: c for c in source.columns if _folded(c, ignore_case) in named}
    target = target.select(*[target[c].alias(renamed.get(c, c)) for c in target.columns])
    if columns:
        return target, list(columns)
    shared = [c for c in source.columns if c in renamed.values()]
    return target, [c for c in shared if _comparable_types(source.schema[c].dataType, target.schema[c].dataType)]


def _folded(name: str, ignore_case: bool) -> str:
    return name.lower() if ignore_case else name


def _comparable_types(source: T.DataType, target: T.DataType) -> bool:
    return carrier(source).simpleString() == carrier(target).simpleString()


def _tagged(source: DataFrame, target: DataFrame, project) -> DataFrame:
    return source.select(F.lit(_SOURCE).alias(_SIDE), *project(source)).unionByName(
        target.select(F.lit(_TARGET).alias(_SIDE), *project(target))
    )


# -- row counts ---------------------------------------------------------------------------------


def compare_row_count(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: source_rows, target_rows, matched."""
    return (
        _tagged(source, target, lambda df: [])
        .agg(_count(_SOURCE).alias("source_rows"), _count(_TARGET).alias("target_rows"))
        .withColumn("matched", F.col("source_rows") == F.col("target_rows"))
    )


# -- schemas --------------------------------------------------------------------------------------


def schema_differences(
    source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None, ignore_case: bool = True
) -> list[tuple[str, str | None, str | None, str]]:
    """(column, source type, target type, status) of each column, or of the listed ones.

    Status is same, widened (an integer or float type of another width, compared by value), type_differs, only_source or
    only_target.
    """
    sides = [{_folded(f.name, ignore_case): f for f in df.schema.fields} for df in (source, target)]
    rows = []
    wanted = {_folded(c, ignore_case) for c in columns or ()}
    for key in [*sides[0], *(k for k in sides[1] if k not in sides[0])]:
        if wanted and key not in wanted:
            continue
        old, new = sides[0].get(key), sides[1].get(key)
        if new is None:
            status = "only_source"
        elif old is None:
            status = "only_target"
        elif old.dataType.simpleString() == new.dataType.simpleString():
            status = "same"
        else:
            status = "widened" if _comparable_types(old.dataType, new.dataType) else "type_differs"
        types = [f.dataType.simpleString() if f is not None else None for f in (old, new)]
        rows.append(((old if old is not None else new).name, *types, status))
    return rows


def same_schema(source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None, ignore_case: bool = True) -> bool:
    return all(row[3] in ("same", "widened") for row in schema_differences(source, target, columns, ignore_case))


def compare_schema(
    source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None, ignore_case: bool = True
) -> DataFrame:
    """One row per column: types, status (see ``schema_differences``), and the non-null values of either copy."""
    listed = schema_differences(source, target, columns, ignore_case)

    def filled(df: DataFrame, side: int) -> DataFrame:
        held = {_folded(c, ignore_case): c for c in df.columns}
        cells = [
            F.struct(F.lit(number).alias("position"), F.count(df[held[_folded(name, ignore_case)]]).alias("n"))
            for number, (name, *_) in enumerate(listed)
            if _folded(name, ignore_case) in held
        ]
        rows = df.agg(F.array(*cells).alias("cells")) if cells else df.sparkSession.createDataFrame([([],)], "cells array<struct<position:int,n:bigint>>")
        return rows.select(F.lit(side).alias(_SIDE), F.inline("cells").alias("position", "n"))

    counts = filled(source, _SOURCE).unionByName(filled(target, _TARGET)).groupBy("position").agg(
        F.max(F.when(_is(_SOURCE), F.col("n"))).alias("source_non_null"), F.max(F.when(_is(_TARGET), F.col("n"))).alias("target_non_null")
    )
    named = source.sparkSession.createDataFrame(
        [(number, *row) for number, row in enumerate(listed)],
        "position int, column_name string, source_type string, target_type string, status string",
    )
    return named.join(counts, "position", "left").select(
        "column_name", "source_type", "target_type", "status", "source_non_null", "target_non_null",
        F.col("status").isin("same", "widened").alias("matched"),
    )


# -- column aggregates --------------------------------------------------------------------------

_METRICS = (
    "non_null", "nulls", "nan_values", "infinite_values", "overflow_values", "distinct_values", "min_value", "max_value",
    "sum_value", "mean_value",
)
_PARTS = (42, 21, 0)  # bits at which a BIGINT is cut for its sum: the parts of 2^41 rows fit into a BIGINT


def _is_ordered(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.AtomicType) and not isinstance(dtype, T.VariantType)


def _has_fixed_width(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.StringType, T.BinaryType)) and not (isinstance(dtype, T.DecimalType) and dtype.precision > 18)


# The aggregates of a column are written as SQL text: a wide table has hundreds of them, and building each one call by call
# takes longer than running them.


def _named(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _value(column: str, kind: T.DataType) -> str:
    """A column in the type it is compared in; equal values of an ordered type have equal bytes."""
    if not _is_ordered(kind):
        return _named(column)
    value = f"CAST({_named(column)} AS {kind.simpleString()})"
    return f"CASE WHEN isnan({value}) THEN double('NaN') ELSE {value} + 0.0D END" if isinstance(kind, T.DoubleType) else value


def _sums(value: str, dtype: T.DataType) -> tuple[str, str, str, str]:
    """(sum, NaN values, infinite values, values beyond the sum) from one aggregate; sums of doubles are taken by bin."""
    if isinstance(dtype, T.DoubleType):
        return "CAST(NULL AS DOUBLE)", f"count_if(isnan({value}))", f"count_if(abs({value}) = double('Infinity'))", "0L"
    if isinstance(dtype, T.LongType):
        mask = (1 << 21) - 1
        cuts = [f"sum(shiftright({value}, {bits}){'' if bits == 42 else f' & {mask}'})" for bits in _PARTS]
        scaled = [f"CAST({cut} AS DECIMAL(25,0)) * CAST({1 << bits}L AS DECIMAL(13,0))" for cut, bits in zip(cuts, _PARTS, strict=True)]
        return f"CAST({' + '.join(scaled)} AS DOUBLE)", "0L", "0L", "0L"
    if isinstance(dtype, T.DecimalType):
        return f"CAST(try_sum({value}) AS DOUBLE)", "0L", "0L", f"CASE WHEN try_sum({value}) IS NULL THEN count({value}) ELSE 0L END"
    return "CAST(NULL AS DOUBLE)", "0L", "0L", "0L"


def _profile(df: DataFrame, columns: list[str], kinds: dict[str, T.DataType], side: int, exact_distinct: bool) -> DataFrame:
    """Rows per column from two aggregates over the table: a row per task is shuffled and no values beside extremes.

    Extremes of texts are taken apart: their buffers grow, which would keep all other aggregates from being compiled.
    """
    texts = [k for k, c in enumerate(columns) if _is_ordered(kinds[c]) and not _has_fixed_width(kinds[c])]

    def extremes(k: int) -> str:
        value = _value(columns[k], kinds[columns[k]])
        return f"'min_value', CAST(min({value}) AS STRING), 'max_value', CAST(max({value}) AS STRING)"

    def plain(k: int) -> str:
        c, kind = columns[k], kinds[columns[k]]
        value = _value(c, kind)
        total, nans, infinite, beyond = _sums(value, kind)
        ends = extremes(k) if _is_ordered(kind) and k not in texts else "'min_value', CAST(NULL AS STRING), 'max_value', CAST(NULL AS STRING)"
        distinct = "CAST(NULL AS BIGINT)" if exact_distinct else f"approx_count_distinct(h{k})"
        return (
            f"named_struct('column', {k}, 'non_null', count({_named(c)}), 'nulls', count(*) - count({_named(c)}), 'nan_values', {nans}, "
            f"'infinite_values', {infinite}, 'overflow_values', {beyond}, {ends}, 'plain_sum', {total}, 'distinct_values', {distinct})"
        )

    hashed = df if exact_distinct else df.select("*", *[_value_hash(df, c, kinds[c]).alias(f"h{k}") for k, c in enumerate(columns)])
    out = hashed.agg(F.expr(f"array({', '.join(plain(k) for k in range(len(columns)))})").alias("cells"))
    out = out.selectExpr(f"{side} AS {_SIDE}", "inline(cells)")
    if texts:
        cells = ", ".join(f"named_struct('column', {k}, {extremes(k)})" for k in texts)
        out = out.unionByName(df.agg(F.expr(f"array({cells})").alias("cells")).selectExpr(f"{side} AS {_SIDE}", "inline(cells)"), allowMissingColumns=True)
    return out


def _value_hash(df: DataFrame, column: str, kind: T.DataType) -> Column:
    value = F.expr(_value(column, kind)) if _is_ordered(kind) else canonical(df[column].cast(kind), kind)
    return F.when(df[column].isNotNull(), F.xxhash64(value))


def _distinct(source: DataFrame, target: DataFrame, columns: list[str], kinds: dict[str, T.DataType]) -> DataFrame:
    """(column, distinct_0, distinct_1), from 64-bit hashes of the values.

    Each copy is counted for itself: reading, hashing and the aggregate before the shuffle are then one compiled loop, which
    a union of the copies below the aggregate would cut in two.
    """

    def counted(df: DataFrame, side: int) -> DataFrame:
        hashes = F.array(*[_value_hash(df, c, kinds[c]) for c in columns])  # longs only, so no object is made per value
        seen = df.select(F.posexplode(hashes).alias("column", "h")).filter("h is not null").distinct()
        return seen.groupBy("column").agg(F.count("*").alias("n")).withColumn(_SIDE, F.lit(side))

    both = counted(source, _SOURCE).unionByName(counted(target, _TARGET))
    return both.groupBy("column").agg(*[F.max(F.when(_is(side), F.col("n"))).alias(f"distinct_{side}") for side in (_SOURCE, _TARGET)])


def _double_sums(source: DataFrame, target: DataFrame, columns: list[str], kinds: dict[str, T.DataType]) -> DataFrame:
    """(column, exact_sum_0, exact_sum_1, same_sum) of the finite values of columns of doubles, from a row per column and bin.

    Columns without a value but zeros are left out.
    """
    cells = ", ".join(
        f"named_struct('column', {k}, 'v', CASE WHEN abs({_named(c)}) < double('Infinity') THEN CAST({_named(c)} AS DOUBLE) END)"
        for k, c in enumerate(columns) if isinstance(kinds[c], T.DoubleType)
    )

    def values(df: DataFrame, side: int) -> DataFrame:
        return df.selectExpr(f"{side} AS {_SIDE}", f"inline(array({cells}))")

    digits = exact_sums.with_digits(values(source, _SOURCE).unionByName(values(target, _TARGET)), "v")
    bins = digits.groupBy("column", _SIDE, "bin").agg(*[F.sum(name).alias(name) for name in exact_sums.NAMES])
    # at most a bin for every 22 powers of two
    listed = f"named_struct('bin', bin, {', '.join(f"'{n}', {n}" for n in exact_sums.NAMES)})"
    by_side = bins.groupBy("column").agg(*[F.expr(f"collect_list({listed}) FILTER (WHERE {_SIDE} = {side})").alias(f"bins_{side}") for side in (_SOURCE, _TARGET)])
    return by_side.mapInArrow(exact_sums.compare_bins, exact_sums.COMPARED)


def compare_column_aggregates(
    source: DataFrame,
    target: DataFrame,
    columns: Sequence[str] | None = None,
    exact_distinct: bool = True,
) -> DataFrame:
    """Per column: counts, nulls, NaN and infinite values, distinct values, min, max, sum and mean on both copies.

    Counts and extremes come from one aggregate per copy, of which a single row per task is shuffled. Doubles are summed
    exactly, by bins of their exponents (see ``exact_sums``), so sums depend neither on order nor on range; ``matched`` compares the exact
    sums, the shown ones are rounded to 15 digits. Distinct values are counted by 64-bit hash, combined before the shuffle; with
    ``exact_distinct=False`` they are HyperLogLog++ estimates from the first aggregate, equal on equal copies. Raw
    values are never shuffled.

    Sums and means are over finite values. ``overflow_values`` counts the values of a decimal column whose sum has too many digits.
    """
    target, columns = _aligned(source, target, columns)
    kinds = {c: carrier(source.schema[c].dataType) for c in columns}
    if not columns:
        return source.sparkSession.createDataFrame([], ", ".join(["column_name string", *[f"{side}_{m} {_METRIC_TYPES.get(m, 'bigint')}" for side in ("source", "target") for m in _METRICS], "matched boolean"]))
    sides = _profile(source, columns, kinds, _SOURCE, exact_distinct).unionByName(_profile(target, columns, kinds, _TARGET, exact_distinct))
    both = [(m, side) for side in (_SOURCE, _TARGET) for m in (*(m for m in _METRICS if m not in ("sum_value", "mean_value")), "plain_sum")]
    wide = sides.groupBy("column").agg(*[F.expr(f"max(CASE WHEN {_SIDE} = {side} THEN {m} END)").alias(f"{m}_{side}") for m, side in both])
    if exact_distinct:
        wide = wide.drop("distinct_values_0", "distinct_values_1").join(_distinct(source, target, columns, kinds), "column", "left")
    doubles = [number for number, c in enumerate(columns) if isinstance(kinds[c], T.DoubleType)]
    if doubles:
        wide = wide.join(_double_sums(source, target, columns, kinds), "column", "left")
    out, number = ["column", f"{'coalesce(same_sum, true)' if doubles else 'true'} AS same_sum"], ", ".join(map(str, doubles))
    for side in (_SOURCE, _TARGET):
        total = f"plain_sum_{side}"
        if doubles:  # without a bin, all finite values are zero
            total = f"CASE WHEN column IN ({number}) THEN coalesce(exact_sum_{side}, 0.0D) ELSE plain_sum_{side} END"
        summed = f"non_null_{side} - nan_values_{side} - infinite_values_{side} - overflow_values_{side}"
        total = f"CASE WHEN {summed} > 0 THEN {total} END"
        computed = {
            "distinct_values": f"coalesce(distinct_{side}, 0L)" if exact_distinct else f"distinct_values_{side}",
            "sum_value": total, "mean_value": f"CASE WHEN {summed} > 0 THEN {total} / ({summed}) END",
        }
        out += [f"{computed.get(m, f'{m}_{side}')} AS {('source', 'target')[side]}_{m}" for m in _METRICS]
    names = F.array(*[F.lit(c) for c in columns])
    same = " AND ".join(f"source_{m} <=> target_{m}" for m in _METRICS)
    shown = [f"{side}_{m}" for side in ("source", "target") for m in _METRICS]
    return wide.selectExpr(*out).select(names[F.col("column")].alias("column_name"), *shown, F.expr(f"same_sum AND {same}").alias("matched"))


_METRIC_TYPES = {"min_value": "string", "max_value": "string", "sum_value": "double", "mean_value": "double"}


# -- keyed rows ---------------------------------------------------------------------------------


def _status(source_rows: Column, target_rows: Column, equal: Column) -> Column:
    return (
        F.when((source_rows > 1) | (target_rows > 1), "duplicate_key")
        .when(target_rows == 0, "missing")
        .when(source_rows == 0, "extra")
        .when(equal, "matched")
        .otherwise("changed")
    )


def compare_row_hash(
    source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Per key: source_rows, target_rows, status matched, changed, missing, extra or duplicate_key, and same_rows.

    ``same_rows`` tells whether the rows under the key are the same bag on both copies; it is what tells a duplicate key
    that was copied as it is from one that was not.
    """
    keys = list(keys)
    target, columns = _aligned(source, target, columns)
    values = [c for c in columns if c not in keys]
    project = lambda df: [*[df[k] for k in keys], (row_hash(df, values) if values else F.lit(0).cast("bigint")).alias("h")]
    parts = (F.col("h").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("h", 32))
    sums = [F.sum(F.when(_is(side), p)).alias(f"h{side}_{i}") for side in (_SOURCE, _TARGET) for i, p in enumerate(parts)]
    mixed = [F.bit_xor(F.when(_is(side), F.xxhash64("h"))).alias(f"h{side}_2") for side in (_SOURCE, _TARGET)]
    grouped = (
        _tagged(source, target, project)
        .groupBy(*keys)
        .agg(_count(_SOURCE).alias("source_rows"), _count(_TARGET).alias("target_rows"), *sums, *mixed)
    )
    same = reduce(lambda a, b: a & b, [F.col(f"h0_{i}").eqNullSafe(F.col(f"h1_{i}")) for i in range(3)])
    same = same & (F.col("source_rows") == F.col("target_rows"))
    status = _status(F.col("source_rows"), F.col("target_rows"), same)
    return grouped.select(*keys, "source_rows", "target_rows", status.alias("status"), same.alias("same_rows"))


def changed_columns(
    source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Keys present once in both copies whose values differ, with the names of the differing columns.

    Carries one BIGINT per column instead of the values, so wide text columns never enter the shuffle.
    """
    keys = list(keys)
    target, columns = _aligned(source, target, columns)
    values = [c for c in columns if c not in keys]
    project = lambda df: [*[df[k] for k in keys], *[cell_hash(df, c).alias(f"h_{c}") for c in values]]
    aggregates = [_count(_SOURCE).alias("n0"), _count(_TARGET).alias("n1")]
    for c in values:
        for side in (_SOURCE, _TARGET):
            aggregates.append(F.max(F.when(_is(side), F.col(f"h_{c}"))).alias(f"h{side}_{c}"))
    grouped = _tagged(source, target, project).groupBy(*keys).agg(*aggregates)
    names = F.array(*[F.when(F.col(f"h0_{c}") != F.col(f"h1_{c}"), F.lit(c)) for c in values], F.lit(None).cast("string"))
    return (
        grouped.filter((F.col("n0") == 1) & (F.col("n1") == 1))
        .select(*keys, F.array_compact(names).alias("changed"))
        .filter(F.size("changed") > 0)
    )


# -- rows without a key ---------------------------------------------------------------------------


def compare_row_bag(
    source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Per distinct row (by 128-bit fingerprint): how often it occurs in each copy."""
    target, values = _aligned(source, target, columns)

    def project(df):
        first, second = row_hash_pair(df, values)
        return [first.alias("h1"), second.alias("h2")]

    return (
        _tagged(source, target, project)
        .groupBy("h1", "h2")
        .agg(_count(_SOURCE).alias("source_rows"), _count(_TARGET).alias("target_rows"))
        .select(
            "h1",
            "h2",
            "source_rows",
            "target_rows",
            F.least("source_rows", "target_rows").alias("common_rows"),
            (F.col("source_rows") - F.least("source_rows", "target_rows")).alias("only_source_rows"),
            (F.col("target_rows") - F.least("source_rows", "target_rows")).alias("only_target_rows"),
        )
    )


def bag_difference(source: DataFrame, target: DataFrame) -> DataFrame:
    """The differing rows themselves with multiplicity: side 'source' or 'target', and copies on that side only.

    One aggregate over whole rows instead of ``exceptAll`` in both directions, which would shuffle each copy
    twice and send all copies of a hot row to one task.
    """
    target, columns = _aligned(source, target, None)
    counts = (
        _tagged(source, target, lambda df: [df[c] for c in columns])
        .groupBy(*columns)
        .agg((_count(_SOURCE) - _count(_TARGET)).alias("surplus"))
        .filter("surplus <> 0")
    )
    return counts.select(
        *columns,
        F.when(F.col("surplus") > 0, "source").otherwise("target").alias("side"),
        F.abs("surplus").alias("copies"),
    )


def bag_intersection(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows common to both copies with the number of common occurrences."""
    target, columns = _aligned(source, target, None)
    return (
        _tagged(source, target, lambda df: [df[c] for c in columns])
        .groupBy(*columns)
        .agg(F.least(_count(_SOURCE), _count(_TARGET)).alias("copies"))
        .filter("copies > 0")
    )


# -- partitions -----------------------------------------------------------------------------------


def partition_compare(
    source: DataFrame, target: DataFrame, partition: Column, columns: Sequence[str] | None = None
) -> DataFrame:
    """Counts and order-insensitive checksums per partition value, to find where two copies differ."""
    target, values = _aligned(source, target, columns)
    project = lambda df: [partition.alias("partition_value"), row_hash(df, values).alias("h")]
    grouped = (
        _tagged(source, target, project)
        .groupBy("partition_value")
        .agg(
            *checksum_aggregates(F.col("h"), _is(_SOURCE), "s_"),
            *checksum_aggregates(F.col("h"), _is(_TARGET), "t_"),
        )
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(f"s_{p}").eqNullSafe(F.col(f"t_{p}")) for p in ("rows", "xor", "sum_low", "sum_mid", "sum_high")],
    )
    return grouped.select(
        "partition_value",
        F.col("s_rows").alias("source_rows"),
        F.col("t_rows").alias("target_rows"),
        same.alias("matched"),
    )


# -- tiered validation ------------------------------------------------------------------------------


@dataclass(frozen=True)
class TablePair:
    """Two copies of one table; the tier decides how deep they are compared.

    A copy is a table, or a function that opens it. The latter is called when its pair is compared, so a table that
    cannot be opened fails its own pair only.
    """

    source_name: str
    target_name: str
    source: DataFrame | Callable[[], DataFrame]
    target: DataFrame | Callable[[], DataFrame]
    tier: str
    keys: Sequence[str] = field(default_factory=tuple)
    exact_distinct: bool = True

    def opened(self) -> tuple[DataFrame, DataFrame]:
        source, target = (t if isinstance(t, DataFrame) else t() for t in (self.source, self.target))
        return source, target


# The checks each tier runs, in the order they are listed; other tiers run the first only.
TIER_CHECKS = {
    "tier1": ("row_count", "column_aggregates", "row_hash"),
    "tier2": ("row_count", "column_aggregates"),
}
DEFAULT_CHECKS = ("row_count",)
#: Pairs that are compared at the same time.
PAIRS_AT_ONCE = 4
_VERDICTS = "source_table string, target_table string, tier string, status string, checks_passed string, checks_failed string, error string"


def _verdict(pair: TablePair, source: DataFrame, target: DataFrame, check: str) -> DataFrame:
    if check == "row_count":
        return compare_row_count(source, target).select(F.col("matched").alias("ok"))
    if check == "column_aggregates":
        found = compare_column_aggregates(source, target, exact_distinct=pair.exact_distinct)
        return found.agg(F.coalesce(F.bool_and("matched"), F.lit(True)).alias("ok"))
    if pair.keys:
        # a duplicate key that was copied as it is is no difference
        bad = (F.col("status") != "matched") & ~((F.col("status") == "duplicate_key") & F.col("same_rows"))
        return compare_row_hash(source, target, pair.keys).agg((F.count_if(bad) == 0).alias("ok"))
    return compare_row_bag(source, target).agg(
        (F.coalesce(F.sum(F.col("only_source_rows") + F.col("only_target_rows")), F.lit(0)) == 0).alias("ok")
    )


def validate_pair(pair: TablePair) -> tuple:
    """A row of ``tiered_validation``: the checks of the pair's tier as one Spark job. An error is a failed pair.

    The schemas are compared first, on all tiers: a lost, added or retyped column fails the pair as the check "schema".
    """
    checks = TIER_CHECKS.get(pair.tier, DEFAULT_CHECKS)
    named = (pair.source_name, pair.target_name, pair.tier)
    try:
        source, target = pair.opened()
        frames = [_verdict(pair, source, target, check).select(F.lit(n).alias("n"), "ok") for n, check in enumerate(checks)]
        ok = {r["n"]: r["ok"] for r in reduce(DataFrame.unionByName, frames).collect()}  # a row per check
        failed = [] if same_schema(source, target) else ["schema"]
        failed += [check for n, check in enumerate(checks) if not ok[n]]
        passed = [check for n, check in enumerate(checks) if ok[n]]
        return (*named, "failed" if failed else "passed", ",".join(passed), ",".join(failed), None)
    except Exception as error:  # one unreadable table must not end the validation of all others
        return (*named, "failed", "", ",".join(checks), f"{type(error).__name__}: {str(error)[:500]}")


def _pair_id(pair: TablePair) -> str:
    """Name of a pair in a journal: what is compared, and how."""
    text = "\u0001".join([pair.source_name, pair.target_name, pair.tier, str(pair.exact_distinct), *pair.keys])
    return hashlib.sha256(text.encode()).hexdigest()


def _recorded(session: SparkSession, journal: str) -> dict[str, tuple]:
    """Verdicts of a journal by pair. Entries that were not finished are not seen: Spark moves a file in place at the end."""
    java = session._jvm
    path = java.org.apache.hadoop.fs.Path(journal)
    if not path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return {}
    rows = session.read.schema(f"pair string, {_VERDICTS}").option("recursiveFileLookup", "true").json(journal).collect()
    return {r["pair"]: tuple(r)[1:] for r in rows if r["error"] is None}


def tiered_validation(pairs: Sequence[TablePair], at_once: int = PAIRS_AT_ONCE, journal: str | None = None) -> DataFrame:
    """Run the checks of each pair's tier; one row per pair with the passed and the failed checks, and any error.

    Each pair is a job of its own from a small pool, so planning a pair costs the same whatever their number. What comes
    back to the driver is one short row per listed pair.

    With a ``journal``, a folder in shared storage, each verdict is written as soon as it is known, and pairs with a verdict
    there are not compared again: a killed run goes on where it stopped. Pairs that ended in an error are tried again.
    """
    if not pairs:
        raise ValueError("no pairs to validate")
    first = next((t for p in pairs for t in (p.source, p.target) if isinstance(t, DataFrame)), None)
    session = first.sparkSession if first is not None else SparkSession.active()
    known = _recorded(session, journal) if journal is not None else {}

    def verdict(pair: TablePair) -> tuple:
        name = _pair_id(pair)
        if name in known:
            return known[name]
        row = validate_pair(pair)
        if journal is not None:
            session.createDataFrame([(name, *row)], f"pair string, {_VERDICTS}").coalesce(1).write.mode("overwrite").json(f"{journal}/{name}")
        return row

    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(verdict, pairs))
    return session.createDataFrame(rows, _VERDICTS)


def validation_report(results: DataFrame) -> DataFrame:
    """Tables validated, passed and failed per tier."""
    return results.groupBy("tier").agg(
        F.count("*").alias("tables_validated"),
        F.count_if(F.col("status") == "passed").alias("tables_passed"),
        F.count_if(F.col("status") != "passed").alias("tables_failed"),
    )


# -- key figures ------------------------------------------------------------------------------------


def within_tolerance(legacy: Column, new: Column, tolerance_pct: Column) -> Column:
    """|new - legacy| <= |legacy| x tolerance / 100; a legacy value of 0 therefore needs an exact match."""
    return F.coalesce(F.abs(new - legacy) <= F.abs(legacy) * tolerance_pct / 100, legacy.isNull() & new.isNull())


def reconcile_kpis(kpis: DataFrame) -> DataFrame:
    """Verdict per row of (name, legacy_value, new_value, tolerance_pct)."""
    legacy, new = F.col("legacy_value"), F.col("new_value")
    return kpis.select(
        *kpis.columns,
        (new - legacy).alias("difference"),
        within_tolerance(legacy, new, F.col("tolerance_pct")).alias("matched"),
    )


def compute_kpis(source: DataFrame, target: DataFrame, kpis: dict[str, tuple[Column, float]]) -> DataFrame:
    """KPI frame from one aggregate per copy: ``{name: (aggregate column, tolerance in percent)}``."""
    names = list(kpis)
    aggregates = [expr.cast("double").alias(f"k{i}") for i, (expr, _) in enumerate(kpis.values())]

    def long(df: DataFrame, column: str) -> DataFrame:
        rows = [F.struct(F.lit(n).alias("name"), F.col(f"k{i}").alias(column)) for i, n in enumerate(names)]
        return df.agg(*aggregates).select(F.inline(F.array(*rows)))

    both = long(source, "legacy_value").withColumn("new_value", F.lit(None).cast("double")).unionByName(
        long(target, "new_value").withColumn("legacy_value", F.lit(None).cast("double"))
    )
    tolerance = F.create_map(*[F.lit(x) for n, (_, tol) in kpis.items() for x in (n, float(tol))])
    return (
        both.groupBy("name")
        .agg(F.max("legacy_value").alias("legacy_value"), F.max("new_value").alias("new_value"))
        .withColumn("tolerance_pct", tolerance[F.col("name")])
    )
