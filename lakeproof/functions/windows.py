"""Window functions that split hot partitions.

A plain window sorts each partition in one task, which is out of balance when one partition holds a large
share of the rows. Here partitions of more than ``hot_rows`` rows are sorted bucket by bucket; all others are one bucket. A
bucket is a range of the order between two splitters, which are drawn from a sample of the partition (see ``_splitters``), or what the caller
names: an expression that grows with the order (the minute of the ordering timestamp, a struct of date and key range). What a bucket needs from those before it (a starting rank, the
last value) is worked out from one row per bucket, and travels as an extra first row of the bucket. So the
rows are shuffled and sorted once, as by a plain window, and results equal the plain window's.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeproof.session import materialize

HOT_ROWS = 1_000_000


def _join_null_safe(rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys of which NULL is a value like others, keeping the left side's."""
    names = {k: f"__key{i}" for i, k in enumerate(keys)}
    renamed = side.withColumnsRenamed(names)
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return rows.join(renamed, condition, how).drop(*names.values())


#: Buckets of a hot partition, and distinct rows of the sample that their splitters are taken from, on average.
BUCKETS = 256
SAMPLE = 16 * BUCKETS


def _splitters(df: DataFrame, partition: Sequence[str], order: Sequence[str], hot: DataFrame) -> DataFrame:
    """Per hot partition an array of at most ``BUCKETS`` rows of the order, at even distances of a sample.

    The sample is drawn by a hash of the order, so equal rows are in it once or not at all: it stays small however often a row
    is repeated. Rows that are equal in the order are peers and need one bucket.
    """
    place = F.struct(*order)
    every = F.greatest(F.lit(1), F.col("__n").try_cast("bigint") / SAMPLE).cast("bigint")
    sampled = _join_null_safe(df.select(*{*partition, *order}), F.broadcast(hot), partition, "inner").filter(F.pmod(F.xxhash64(*order, F.lit("split")), every) == 0)
    listed = sampled.groupBy(*partition).agg(F.array_sort(F.collect_set(place)).alias("__sample"))
    step = F.greatest(F.lit(1), F.ceil(F.size("__sample") / BUCKETS).cast("int"))
    even = F.filter("__sample", lambda _, i: i % F.col("__step") == 0)
    return listed.withColumn("__step", step).select(*partition, even.alias("__splits"))


def _bucket_of(order: Sequence[str]) -> Column:
    """How many splitters are not above a row, by halving."""
    row, splits = F.struct(*order), F.col("__splits")

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        below = (state["low"] < state["high"]) & (F.get(splits, middle) <= row)
        return F.struct(F.when(below, middle + 1).otherwise(state["low"]).alias("low"), F.when(below | (state["low"] >= state["high"]), state["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.coalesce(F.size(splits), F.lit(0)).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(BUCKETS.bit_length())), start, halve, lambda state: state["low"])


def _bucketed(df: DataFrame, partition: Sequence[str], bucket: Column | None, hot_rows: int, order: Sequence[str]) -> DataFrame:
    """Add __bucket, NULL in partitions that are not hot."""
    counts = df.groupBy(*partition).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_rows)
    # at most (number of rows / hot_rows) partitions are hot
    if bucket is not None:
        hot, at = counts.select(*partition, F.lit(True).alias("__hot")), bucket
    else:
        counts = materialize(counts)
        found = _join_null_safe(counts, _splitters(df, partition, order, counts), partition, "left")
        hot, at = found.select(*partition, F.lit(True).alias("__hot"), "__splits"), _bucket_of(order)
    return _join_null_safe(df, F.broadcast(hot), partition, "left").withColumn(
        "__bucket", F.when(F.col("__hot"), F.struct(at.alias("at")))
    ).drop("__hot", "__splits")


def _with_first_rows(rows: DataFrame, first_rows: DataFrame) -> DataFrame:
    flagged = first_rows.withColumn("__first", F.lit(True))
    return rows.withColumn("__first", F.lit(False)).unionByName(flagged, allowMissingColumns=True)


def ranked(
    df: DataFrame, partition: Sequence[str], order: Sequence[str], bucket: Column | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Adds __row_number, __peers_end (rows up to and including peers) and __rows (partition size).

    Reads its input up to four times, so give it a scan or a written table.
    """
    partition = list(partition)
    rows = _bucketed(df, partition, bucket, hot_rows, order)
    counts = rows.filter("__bucket IS NOT NULL").groupBy(*partition, "__bucket").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*partition).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *partition,
        "__bucket",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"),
        F.sum("__n").over(Window.partitionBy(*partition)).alias("__size"),
    )
    whole = Window.partitionBy(*partition, "__bucket")
    local = whole.orderBy(F.desc("__first"), *order)
    # the extra first row counts as one
    start = F.coalesce(F.max("__start").over(whole) - 1, F.lit(0))
    return (
        _with_first_rows(rows, starts)
        .select(
            *df.columns,
            "__first",
            (start + F.row_number().over(local)).alias("__row_number"),
            (start + F.count(F.lit(1)).over(local)).alias("__peers_end"),
            F.coalesce(F.max("__size").over(whole), F.count(F.lit(1)).over(whole)).alias("__rows"),
        )
        .filter("NOT __first")
        .drop("__first")
    )


def row_number() -> Column:
    return F.col("__row_number")


def cume_dist() -> Column:
    return F.col("__peers_end") / F.col("__rows")


def ntile(n: int) -> Column:
    """The first (rows mod n) tiles hold one row more."""
    position, size = F.col("__row_number") - 1, F.expr(f"__rows div {n}")
    larger = F.col("__rows") % n
    in_larger = larger * (size + 1)
    wide = F.floor(position / (size + 1)) + 1
    narrow = larger + F.floor((position - in_larger) / F.greatest(size, F.lit(1))) + 1
    return F.when(position < in_larger, wide).otherwise(narrow).cast("int")


def with_nth_value(ranked_rows: DataFrame, partition: Sequence[str], value: str, n: int, name: str) -> DataFrame:
    """Adds the n-th value of each partition, NULL on rows before it (frame up to the current row and peers)."""
    partition = list(partition)
    nth = ranked_rows.filter(F.col("__row_number") == n).select(*partition, F.col(value).alias("__nth"))
    return (
        _join_null_safe(ranked_rows, nth, partition, "left")
        .withColumn(name, F.when(F.col("__peers_end") >= n, F.col("__nth")))
        .drop("__nth")
    )


def lag_in_buckets(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[str],
    bucket: Column | None,
    value: str,
    name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``lag(value)`` over the partition: the extra first row of a bucket holds the last value before it."""
    partition = list(partition)
    rows = _bucketed(df, partition, bucket, hot_rows, order)
    last = (
        rows.filter("__bucket IS NOT NULL")
        .groupBy(*partition, "__bucket")
        .agg(F.max_by(value, F.struct(*order)).alias("__last"))
    )
    before = F.lag("__last").over(Window.partitionBy(*partition).orderBy("__bucket"))
    carried = last.select(*partition, "__bucket", before.alias(value))
    local = Window.partitionBy(*partition, "__bucket").orderBy(F.desc("__first"), *order)
    return (
        _with_first_rows(rows, carried)
        .select(*df.columns, "__first", F.lag(value).over(local).alias(name))
        .filter("NOT __first")
        .drop("__first")
    )


def last_at_or_before(df: DataFrame, order: Sequence[str], value: str, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds the last value that is not NULL at or before each row, in the order of the whole table.

    The table is one partition, so beyond ``hot_rows`` rows it is cut into ranges. A range starts with the last value of those
    before it, which is found from a row per range.
    """
    whole = df.withColumn("__all", F.lit(0))
    rows = _bucketed(whole, ["__all"], None, hot_rows, order)
    last = rows.filter(F.col("__bucket").isNotNull()).groupBy("__all", "__bucket").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__last"))
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy("__all").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select("__all", "__bucket", before.alias(value))
    local = Window.partitionBy("__all", "__bucket").orderBy(F.desc("__first"), *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = _with_first_rows(rows, carried).withColumn(name, F.last(value, ignorenulls=True).over(local))
    return found.filter("NOT __first").select(*df.columns, name)
