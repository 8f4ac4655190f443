"""Comparison of two copies by a tree of key ranges: digests first, rows only where digests differ.

The root is the range of all keys, and each node has ``fanout`` equal ranges below it. A level digests the rows of the unequal
nodes of the level above, one row per node and task, so equal ranges are left after one look. The rows of unequal
ranges alone are compared key by key at the end; with few differences next to nothing is shuffled. Ranges of a single integer
key are pushed to the scan as bounds, so files sorted by key are skipped. Other keys are put in order by a hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeproof.operators import compare
from lakeproof.operators.hashing import checksum_aggregates, row_hash
from lakeproof.session import facts, materialize

FANOUT = 64
LEAF_ROWS = 10_000
_PARTS = ("rows", "xor", "sum_low", "sum_mid", "sum_high")


@dataclass(frozen=True)
class Level:
    """What a level of the tree has read and found."""

    level: int
    nodes: int
    unequal_nodes: int
    rows_read: int
    unequal_rows: int


@dataclass(frozen=True)
class TreeComparison:
    """``levels`` from the root down, and ``rows``: the statuses of ``compare_row_hash`` for the keys of unequal leaves."""

    levels: list[Level]
    rows: DataFrame

    def level_table(self) -> DataFrame:
        names = "level int, nodes bigint, unequal_nodes bigint, rows_read bigint, unequal_rows bigint"
        return self.rows.sparkSession.createDataFrame([(x.level, x.nodes, x.unequal_nodes, x.rows_read, x.unequal_rows) for x in self.levels], names)


def _span(source: DataFrame, target: DataFrame, keys: list[str]) -> tuple[int, int] | None:
    """(least, greatest) of a single integer key, or None where keys are ordered by a hash."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if len(keys) != 1 or not all(isinstance(df.schema[keys[0]].dataType, whole) for df in (source, target)):
        return None
    ends = [df.agg(F.min(df[keys[0]]).cast("bigint"), F.max(df[keys[0]]).cast("bigint")).first() for df in (source, target)]
    low, high = [x[0] for x in ends if x[0] is not None], [x[1] for x in ends if x[1] is not None]
    if not low or max(high) - min(low) >= 1 << 62:
        return None
    return min(low), max(high)


def compare_by_tree(
    source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS
) -> TreeComparison:
    """Descend into unequal ranges until they have at most ``leaf_rows`` rows (of both copies) or a single key.

    ``rows`` lists every key whose rows differ between the copies, with the status of ``compare_row_hash``, and the equal keys that
    share a leaf with one. A key that is NULL, or in a copy of no rows, is a key like any other.
    """
    keys = list(keys)
    target, columns = compare._aligned(source, target, columns)
    values = [c for c in columns if c not in keys]
    span = _span(source, target, keys)
    low, width = (span[0], span[1] - span[0] + 1) if span else (0, 1 << 62)

    def place(df: DataFrame) -> Column:
        if span:
            return F.coalesce(df[keys[0]].cast("bigint") - low, F.lit(0))
        return F.shiftrightunsigned(F.xxhash64(*[df[k].cast(compare.carrier(source.schema[k].dataType)) for k in keys]), 2)

    def within(df: DataFrame, bounds: tuple[int, int] | None) -> DataFrame:
        if bounds is None or not span:
            return df
        inside = df[keys[0]].between(low + bounds[0], low + bounds[1])
        return df.filter(inside | df[keys[0]].isNull() if bounds[0] <= 0 else inside)

    def digested(size: int, above: DataFrame | None, above_size: int, bounds) -> DataFrame:
        sides = []
        for side, df in enumerate((source, target)):
            rows = within(df, bounds)
            rows = rows.select(F.lit(side).alias("side"), place(rows).alias("place"), row_hash(rows, [*keys, *values]).alias("h"))
            sides.append(rows)
        rows = sides[0].unionByName(sides[1])
        if above is not None:
            rows = rows.join(above.select(F.col("node").alias("parent")), F.expr(f"place div {above_size}L") == F.col("parent"), "left_semi")
        nodes = rows.groupBy(F.expr(f"place div {size}L").alias("node")).agg(
            *checksum_aggregates(F.col("h"), F.col("side") == 0, "s_"), *checksum_aggregates(F.col("h"), F.col("side") == 1, "t_")
        )
        same = " AND ".join(f"s_{p} <=> t_{p}" for p in _PARTS)
        return nodes.selectExpr("node", "s_rows + t_rows AS n", f"{same} AS equal")

    levels, above, above_size, bounds, size = [], None, width, None, width
    while True:
        found = materialize(
            digested(size, above, above_size, bounds),
            nodes=F.count("*"), unequal=F.count_if(~F.col("equal")), n=F.sum("n"), unequal_rows=F.sum(F.when(~F.col("equal"), F.col("n"))),
            largest=F.max(F.when(~F.col("equal"), F.col("n"))), first=F.min(F.when(~F.col("equal"), F.col("node"))), last=F.max(F.when(~F.col("equal"), F.col("node"))),
        )
        seen = facts(found)
        levels.append(Level(len(levels), seen["nodes"], seen["unequal"], seen["n"] or 0, seen["unequal_rows"] or 0))
        above, above_size = found.filter("NOT equal").select("node"), size
        if not seen["unequal"]:
            break
        bounds = (seen["first"] * size, min(width, (seen["last"] + 1) * size) - 1)
        if size == 1 or seen["largest"] <= leaf_rows:
            break
        size = max(1, -(-size // fanout))
    if not levels[-1].unequal_nodes:
        bounds = (0, -1)
    leaves = []
    for df in (source, target):
        rows = within(df, bounds)
        leaves.append(rows.join(above, F.call_function("div", place(rows), F.lit(above_size).cast("bigint")) == above["node"], "left_semi"))
    return TreeComparison(levels, compare.compare_row_hash(*leaves, keys, columns))

