"""Whole tasks over folders and files: read, run the operators, write, and return the report.

Each function is the operators of one task in order; Spark does the scheduling.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeproof.operators import compare, gates, graph, inventory, lookups, text_rules, waves
from lakeproof.rulesets.lake_sql import LAKE_SQL_RULES, Rule
from lakeproof.session import materialize
from lakeproof.sources import readers, writers


class Detailed(NamedTuple):
    """A report and the rows behind it."""

    report: DataFrame
    details: DataFrame


# -- inventory and waves ----------------------------------------------------------------------------


def classify_inventory(spark: SparkSession, path: str, as_of: Column) -> Detailed:
    """Tiers of all tables of the saved inventories, with the counts per inventory."""
    classified = inventory.classify_tiers(readers.scan_inventory(spark, path), as_of)
    counts = classified.groupBy("inventory_id").agg(
        F.count("*").alias("total_tables"),
        *[F.count_if(F.col("tier") == t).alias(f"{t.lower().replace('_', '')}_count") for t in inventory.TIERS],
    )
    return Detailed(counts, classified)


def plan_inventory_waves(
    spark: SparkSession, path: str, lobs: Sequence[str], as_of: Column, max_parallel: int = 3
) -> Detailed:
    """A plan per saved inventory; tables keep the order of their names within a tier."""
    classified = classify_inventory(spark, path, as_of).details
    # sorted before numbering, so that the number grows with the name
    numbered = materialize(
        classified.select("inventory_id", "database", "table_name", "tier")
        .orderBy("table_name", "database")
        .withColumn("position", F.monotonically_increasing_id())
    )
    plans = ["inventory_id"]
    return Detailed(
        waves.wave_plan_report(numbered, lobs, max_parallel, plans), waves.plan_waves(numbered, lobs, max_parallel, plans=plans)
    )


def list_tables(spark: SparkSession, database: str, tables: dict[str, DataFrame | str]) -> DataFrame:
    """Inventory rows of tables given as DataFrames or paths, with ``has_maps`` read from their schemas.

    Rows are counted; sizes are those of the files, where a table has files.
    """
    rows = []
    for name, table in tables.items():
        frame = spark.read.parquet(table) if isinstance(table, str) else table
        files = frame.inputFiles()
        size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] if files else 0
        rows.append((database, name, int(size or 0), frame.count(), inventory.schema_has_maps(frame.schema)))
    return spark.createDataFrame(rows, "database string, table_name string, size_bytes bigint, row_count bigint, has_maps boolean")


def check_logs(spark: SparkSession, paths: str | Sequence[str]) -> Detailed:
    """Log health per table of log folders (a glob such as ``base/*/_delta_log``), and the compaction plan."""
    sizes = inventory.log_sizes(readers.scan_file_listing(spark, paths))
    return Detailed(inventory.log_health(sizes), inventory.compaction_plan(sizes))


# -- SQL ------------------------------------------------------------------------------------------------


def translate_folder(
    spark: SparkSession, source: str, output: str, rules: Sequence[Rule] = LAKE_SQL_RULES, glob: str = "*.sql"
) -> DataFrame:
    """Rewrite all files of a folder into a table of (path, rewritten, applied, status, error); returns the summary.

    A file that is no text fails by itself: it is listed with its error and without a rewritten text.
    """
    files = readers.scan_text_outcomes(spark, source, glob)
    rewritten = text_rules.apply_rules(files, "content", rules)
    failed = F.col("error").isNotNull()
    rewritten.select(
        "path",
        F.when(~failed, F.col("rewritten")).alias("rewritten"),
        F.when(failed, F.array().cast("array<string>")).otherwise(F.col("applied")).alias("applied"),
        F.when(failed, "failed").otherwise("translated").alias("status"),
        "error",
    ).write.mode("overwrite").parquet(output)
    return text_rules.translation_summary(spark.read.parquet(output), rules=rules)


def classify_code_file(spark: SparkSession, path: str) -> Detailed:
    """Class of each body of a JSON object of name -> body."""
    bodies = readers.scan_kv_json(spark, path)
    classified = text_rules.classify_code(bodies, "value").select("name", "category")
    return Detailed(text_rules.classify_code_report(classified), classified)


def validate_queries(spark: SparkSession, paths: DataFrame, folder: str, glob: str = "*.sql") -> Detailed:
    """Report on query outcomes (path, error) with the estimated bytes of the texts below a folder."""
    outcomes = text_rules.query_outcomes(paths, readers.scan_text_corpus(spark, folder, glob), "path", "content")
    return Detailed(text_rules.query_validation_report(outcomes), text_rules.query_validation_failures(outcomes, "path"))


# -- dependencies -----------------------------------------------------------------------------------------


def analyse_dependencies(spark: SparkSession, path: str) -> Detailed:
    """Cascades of a JSON object of table -> dependent tables, and the groups that must move together."""
    listed = readers.scan_kv_json(spark, path, "ARRAY<STRING>")
    edges = listed.select(F.col("name").alias("src"), F.explode("value").alias("dst"))
    nodes = listed.select(F.col("name").alias("node"))
    return Detailed(graph.cascade(edges, nodes), graph.co_migration_batches(edges, nodes))


def scan_jobs(spark: SparkSession, paths: str | Sequence[str], glob: str = "*") -> Detailed:
    """Dependencies found in job files; bytes that are not UTF-8 are replaced."""
    files = readers.scan_text_corpus(spark, paths, glob, replace_invalid=True)
    hits = text_rules.scan_dependencies(files, "content")
    return Detailed(text_rules.dependency_report(hits), hits)


def rewrite_workflows(spark: SparkSession, source: str, output: str, glob: str = "*.py") -> Detailed:
    """Rewrite workflow files into a table of (path, rewritten, changes); returns the report and the changes."""
    files = readers.scan_text_corpus(spark, source, glob)
    text_rules.rewrite_workflow_files(files, "content").select("path", "rewritten", "changes").write.mode("overwrite").parquet(output)
    written = spark.read.parquet(output)
    return Detailed(text_rules.rewrite_report(written), text_rules.rewrite_changes(written, "path"))


def check_functions(spark: SparkSession, path: str) -> DataFrame:
    """Which functions of a JSON object of name -> source need a rewrite."""
    return text_rules.has_athena_reference(readers.scan_kv_json(spark, path), "value").select("name", "status")


def map_policies(spark: SparkSession, path: str) -> DataFrame:
    """Roles of the policies of a JSON file."""
    return lookups.map_permissions(readers.scan_json_records(spark, path, "permissions"))


# -- validation and cutover -----------------------------------------------------------------------------------


def validate_tables(
    spark: SparkSession,
    tier: str,
    table_pairs: Sequence[tuple[str, str]],
    primary_keys: dict[str, Sequence[str]] | None = None,
    event_log: str | None = None,
    at: Column | None = None,
) -> Detailed:
    """Compare pairs of named tables or views at a tier; optionally append the outcome to an event log."""
    # opened when it is its turn, so that a missing table fails its pair only
    pairs = [
        compare.TablePair(s, t, partial(spark.table, s), partial(spark.table, t), tier, tuple((primary_keys or {}).get(s, ())))
        for s, t in table_pairs
    ]
    details = compare.tiered_validation(pairs)
    if event_log is not None:
        # one row per pair; kept, so that report and log are the same run
        details = materialize(details)
    report = compare.validation_report(details)
    if event_log is not None:
        time = at if at is not None else F.current_timestamp()
        fields = ["tier", "tables_validated", "tables_passed", "tables_failed"]
        writers.append_events(writers.event_rows(report, "ValidationCompleted", F.col("tier"), time, fields), event_log)
    return Detailed(report, details)


def reconcile_kpi_file(spark: SparkSession, path: str) -> DataFrame:
    return compare.reconcile_kpis(readers.scan_json_records(spark, path, "kpis"))


def check_gate_file(spark: SparkSession, path: str, wave_id: str, required: Sequence[str] = gates.REQUIRED_CRITERIA) -> DataFrame:
    """Gate verdict for a JSON object of criterion -> met."""
    criteria = spark.read.text(path, wholetext=True).select(
        F.lit(wave_id).alias("wave_id"), F.from_json("value", "MAP<STRING,BOOLEAN>").alias("criteria")
    )
    return gates.enforce_gate(criteria, required=required)
