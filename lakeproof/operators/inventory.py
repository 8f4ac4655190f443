"""Inventory analytics: tiers, lines of business, log health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeproof.functions.windows import last_at_or_before

INVENTORY_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("database", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("last_queried", T.TimestampType()),
        T.StructField("partitioned", T.BooleanType()),
        T.StructField("format", T.StringType()),
        T.StructField("has_maps", T.BooleanType()),
    ]
)

# Tier thresholds and reason texts.
SIZE_LIMIT_BYTES = 1_099_511_627_776
IDLE_DAYS = 90
TIERS = ("TIER_1", "TIER_2", "TIER_3")
REASON_NEVER = "Table has never been queried"
REASON_IDLE = "Not queried in %d days (>= %d)"
REASON_SMALL = "Queried %d days ago, size < 1 TB"
REASON_LARGE = "Queried %d days ago, size >= 1 TB"

# Log size limits in MiB with status, advice and expected reduction in percent.
BYTES_PER_MB = 1_048_576
LOG_HEALTH = (
    (10.0, "BLOCKED", "Must compact Delta log before migration", 80.0),
    (9.0, "CRITICAL", "Run OPTIMIZE followed by VACUUM", 60.0),
    (7.0, "WARNING", "Run OPTIMIZE to reduce log size", 40.0),
)
LOG_HEALTHY = ("HEALTHY", "No action needed", 0.0)


# -- tiers --------------------------------------------------------------------------------------


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days, rounded toward the past, so that a future date gives -1 and not 0."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("int")


def classify_tiers(
    inventory: DataFrame,
    as_of: Column,
    size: str = "size_bytes",
    last_used: str = "last_queried",
    size_limit: int = SIZE_LIMIT_BYTES,
    idle_days: int = IDLE_DAYS,
) -> DataFrame:
    """Add tier, reason and last_queried_days_ago."""
    days = days_between(F.col(last_used), as_of)
    idle, small = days >= idle_days, F.col(size) < size_limit
    tier = (
        F.when(F.col(last_used).isNull() | idle, "TIER_3").when(small, "TIER_1").otherwise("TIER_2")
    )
    reason = (
        F.when(F.col(last_used).isNull(), REASON_NEVER)
        .when(idle, F.format_string(REASON_IDLE, days, F.lit(idle_days)))
        .when(small, F.format_string(REASON_SMALL, days))
        .otherwise(F.format_string(REASON_LARGE, days))
    )
    return inventory.select(
        "*", tier.alias("tier"), reason.alias("reason"), days.alias("last_queried_days_ago")
    )


def tier_entities(
    facts: DataFrame, entity: str, size: Column, used_at: Column, as_of: Column, size_limit: float, idle_days: int
) -> DataFrame:
    """Tiers of entities found in a fact table: size is the sum, last use the latest time."""
    sizes = facts.groupBy(entity).agg(F.sum(size).alias("size"), F.max(used_at).alias("last_used"))
    return classify_tiers(sizes, as_of, "size", "last_used", size_limit, idle_days)


def filter_by_tier(classified: DataFrame, tier: str) -> DataFrame:
    return classified.filter(F.col("tier") == tier)


def tables_with_maps(inventory: DataFrame) -> DataFrame:
    return inventory.filter("has_maps")


def schema_has_maps(dtype: T.DataType) -> bool:
    """Whether a schema holds a MAP at any depth; feeds the has_maps column."""
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return schema_has_maps(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(schema_has_maps(f.dataType) for f in dtype.fields)
    return False


def tier_counts(classified: DataFrame) -> DataFrame:
    """One row; tiers without tables count 0."""
    return classified.agg(
        F.count("*").alias("total_tables"),
        *[F.count_if(F.col("tier") == t).alias(f"{t.lower().replace('_', '')}_count") for t in TIERS],
    )


def tier_summary(tables: DataFrame, size: str = "size_bytes") -> DataFrame:
    """Count and bytes per tier; the total includes unclassified tables (tier NULL)."""
    aggregates = [F.count("*").alias("total_tables")]
    for t in TIERS:
        name = t.lower().replace("_", "")
        mine = F.col("tier") == t
        aggregates.append(F.count_if(mine).alias(f"{name}_count"))
        aggregates.append(F.coalesce(F.sum(F.when(mine, F.col(size))), F.lit(0)).alias(f"{name}_size_bytes"))
    return tables.agg(*aggregates)


def tier_rollup(classified: DataFrame, size: str = "size_bytes") -> DataFrame:
    """Subtotals by database and tier; level 0 is one tier of a database, 1 a database, 3 the total."""
    return classified.rollup("database", "tier").agg(
        F.grouping_id().alias("level"), F.count("*").alias("tables"), F.sum(size).alias("size_bytes")
    )


def severity_counts(issues: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    error = F.col("severity") == "ERROR"
    return issues.groupBy(*group).agg(
        F.count_if(~error).alias("passed_count"), F.count_if(error).alias("failed_count")
    )


# -- classification joins -------------------------------------------------------------------------

TABLE_KEY = ("database", "table_name")


def join_classification(inventory: DataFrame, classifications: DataFrame, key=TABLE_KEY) -> DataFrame:
    return inventory.join(classifications, list(key), "inner")


def classified_only(inventory: DataFrame, classifications: DataFrame, key=TABLE_KEY) -> DataFrame:
    return inventory.join(classifications, list(key), "left_semi")


def unclassified(inventory: DataFrame, classifications: DataFrame, key=TABLE_KEY) -> DataFrame:
    return inventory.join(classifications, list(key), "left_anti")


# -- lines of business ------------------------------------------------------------------------------


def resolve_lob(table_name: Column, lobs: Sequence[str]) -> Column:
    """The longest name that is a prefix of the table name, whatever the case; else the first; else 'default'.

    The names are a short configured list, so this is one expression and no join; see ``prefix_join`` for
    names held in a table.
    """
    names = sorted(set(lobs))
    out = F.lit(names[0] if names else "default")
    for lob in sorted(names, key=len):
        out = F.when(F.lower(table_name).startswith(lob.lower()), F.lit(lob)).otherwise(out)
    return out


def assign_lob(tables: DataFrame, lobs: Sequence[str], name: str = "table_name") -> DataFrame:
    return tables.withColumn("lob", resolve_lob(F.col(name), lobs))


def prefix_join(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str, out: str) -> DataFrame:
    """Add the longest matching prefix (any case) from a table of prefixes, NULL without one.

    A prefix test is a theta join, which Spark can only run as a nested loop. Instead there is one equi left
    join per prefix length: equal after cutting the text to that length. Lengths are few, and each join can be
    broadcast, or shuffled and split by AQE, depending on measured sizes.
    """
    names = prefixes.select(F.col(prefix).alias("__p"), F.lower(prefix).alias("__key")).filter("length(__key) > 0")
    names = names.groupBy("__key").agg(F.min("__p").alias("__p"))
    # bounded by the longest prefix, not by the number of prefixes
    lengths = [r["n"] for r in names.select(F.length("__key").alias("n")).distinct().orderBy(F.desc("n")).collect()]
    joined = rows.withColumn(out, F.lit(None).cast("string"))
    for n in lengths:
        side = names.filter(F.length("__key") == n).select("__key", F.col("__p").alias("__found"))
        joined = (
            joined.join(side, F.lower(F.substring(text, 1, n)) == F.col("__key"), "left")
            .withColumn(out, F.coalesce(out, "__found"))
            .drop("__key", "__found")
        )
    return joined


def prefix_join_by_order(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str, out: str, hot_rows: int = 100_000) -> DataFrame:
    """``prefix_join`` with one exchange of the rows, however many prefixes and lengths there are.

    In the order of the texts, all prefixes of a text are the last prefix before it or the prefixes of that one: what stands between a
    prefix and a text that begins with it begins with it, too. So each prefix is given the list of those it is nested in, rows and
    prefixes are sorted together, and a row takes the longest of the list that fits. Use it where prefixes are too many to be broadcast.
    """
    names = prefixes.select(F.lower(prefix).alias("key"), F.col(prefix).alias("name")).filter("length(key) > 0").groupBy("key").agg(F.min("name").alias("name"))
    # a list is at most as long as its prefix has letters
    cut = names.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).select("key", F.expr("substring(key, 1, n)").alias("outer"))
    nested = cut.join(names.select(F.col("key").alias("outer"), "name"), "outer").groupBy("key")
    nested = nested.agg(F.sort_array(F.collect_list(F.struct(F.length("outer").alias("n"), "outer", "name")), asc=False).alias("nested"))
    both = rows.select(F.lower(text).alias("key"), F.lit(1).alias("kind"), F.struct(*rows.columns).alias("row")).unionByName(
        nested.select("key", F.lit(0).alias("kind"), "nested"), allowMissingColumns=True
    )
    found = last_at_or_before(both, ["key", "kind"], "nested", "last", hot_rows).filter("kind = 1")
    fits = F.filter("last", lambda p: F.startswith(F.col("key"), p["outer"]))
    return found.select("row.*", F.get(fits, F.lit(0))["name"].alias(out))


# -- transaction logs ---------------------------------------------------------------------------------


def log_table_name(path: Column) -> Column:
    """Last path part before the log folder, NULL elsewhere."""
    return F.nullif(F.regexp_extract(path, r"([^/]+)/_delta_log/", 1), F.lit(""))


def log_table_path(path: Column) -> Column:
    """Full path before the log folder: the key, as tables of different folders may share a name."""
    return F.nullif(F.regexp_extract(path, r"^(.*?)/_delta_log/", 1), F.lit(""))


def log_sizes(files: DataFrame) -> DataFrame:
    """Sum the log files of each table of a (path, length) listing."""
    return (
        files.select(log_table_path(F.col("path")).alias("table_path"), log_table_name(F.col("path")).alias("table_name"), "length")
        .filter("table_path IS NOT NULL")
        .groupBy("table_path", "table_name")
        .agg(F.sum("length").alias("log_bytes"))
    )


def _by_log_size(log_mb: Column, field: int) -> Column:
    out = F.lit(LOG_HEALTHY[field])
    for limit, *values in reversed(LOG_HEALTH):
        out = F.when(log_mb >= limit, F.lit(values[field])).otherwise(out)
    return out


def log_health(logs: DataFrame, size: str = "log_bytes") -> DataFrame:
    """Add log_size_mb, status and recommendation."""
    mb = F.col(size) / F.lit(BYTES_PER_MB)
    return logs.select(
        "*", mb.alias("log_size_mb"), _by_log_size(mb, 0).alias("status"), _by_log_size(mb, 1).alias("recommendation")
    )


def compaction_plan(logs: DataFrame, size: str = "log_bytes") -> DataFrame:
    mb = F.col(size) / F.lit(BYTES_PER_MB)
    return logs.select(
        *[c for c in logs.columns if c != size],
        F.col(size).alias("current_size_bytes"),
        _by_log_size(mb, 2).alias("estimated_reduction_pct"),
        _by_log_size(mb, 1).alias("recommended_action"),
    )
