"""Scans of saved inventories, text corpora, file listings and JSON documents.

Paths carry their scheme (s3a://, gs://, file:/), so object stores and local folders read alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeproof.operators.inventory import INVENTORY_SCHEMA

INVENTORY_DOCUMENT = T.StructType(
    [
        T.StructField("inventory_id", T.StringType()),
        T.StructField("tables", T.ArrayType(INVENTORY_SCHEMA)),
    ]
)

# Record layouts of the configuration files.
RECORD_SCHEMAS = {
    "kpis": "name STRING, legacy_value DOUBLE, new_value DOUBLE, tolerance_pct DOUBLE",
    "permissions": "permission STRING, resource STRING, principal STRING",
    "table_pairs": "source_table STRING, target_table STRING",
    "primary_keys": "table_name STRING, columns ARRAY<STRING>",
    "topics": "topic STRING, partitions INT, replication_factor INT, schema STRING, schema_registry STRING",
    "dashboards": "name STRING, source STRING, target STRING, datasets ARRAY<STRING>, tool STRING",
}


def scan_inventory(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per table of saved inventories: one document per file, or one per line without ``multi_line``.

    Files of one document cannot be split; large inventories belong in several documents with the same id.
    """
    documents = spark.read.schema(INVENTORY_DOCUMENT).json(path, multiLine=multi_line)
    tables = documents.select("inventory_id", F.inline("tables"))
    return tables.withColumn("format", F.coalesce("format", F.lit("PARQUET"))).withColumn(
        "has_maps", F.coalesce("has_maps", F.lit(False))
    )


def scan_text_corpus(
    spark: SparkSession, paths: str | Sequence[str], glob: str = "*.sql", replace_invalid: bool = False
) -> DataFrame:
    """(path, content), one row per file below the paths.

    With ``replace_invalid`` bytes that are not UTF-8 become U+FFFD.
    """
    if replace_invalid:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)
        return files.select("path", _decoded(F.col("content")).alias("content"))
    texts = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def scan_text_outcomes(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.sql") -> DataFrame:
    """(path, content, error), one row per file: a file whose bytes are not UTF-8 has an error and no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return files.select(
        "path", F.when(valid, text).alias("content"), F.when(~valid, "the file is not UTF-8 text").alias("error")
    )


def _decoded(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def scan_file_listing(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """(path, length, modificationTime); file contents are not read.

    Folders that begin with an underscore are skipped below a path but not at it: list logs with a glob such
    as ``base/*/_delta_log``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(paths).select("path", "length", "modificationTime")


def scan_kv_json(spark: SparkSession, path: str, value_type: str = "STRING", whole_file: bool = True) -> DataFrame:
    """(name, value) rows of JSON objects: one object per file, or one per line without ``whole_file``."""
    text = spark.read.text(path, wholetext=whole_file)
    entries = F.from_json("value", f"MAP<STRING,{value_type}>")
    return text.select(F.explode(entries).alias("name", "value"))


def scan_json_records(spark: SparkSession, path: str, schema: str | T.StructType, multi_line: bool = True) -> DataFrame:
    """Rows of JSON arrays of records: one array per file, or one per line without ``multi_line``."""
    return spark.read.schema(RECORD_SCHEMAS.get(schema, schema) if isinstance(schema, str) else schema).json(
        path, multiLine=multi_line
    )
