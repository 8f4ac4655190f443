"""Running a stream to the end of the available data."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lakeproof.session import prepare, scratch_path

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, glob: str, schema: T.StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; another source needs no more than another format here.

    Raises if no file matches now: a stream over nothing would end without rows and without an error.
    """
    if not spark.read.schema(schema).option("pathGlobFilter", glob).parquet(folder).inputFiles():
        raise FileNotFoundError(f"no file in {folder} matches {glob}")
    reader = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def table_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of part files."""
    path = path.rstrip("/")
    files = spark.read.schema(schema).parquet(path).inputFiles()
    folder, name = posixpath.split(path)
    single = len(files) == 1 and posixpath.basename(unquote(urlparse(files[0]).path)) == name
    return file_stream(spark, *((folder, name) if single else (path, "*.parquet")), schema, files_per_trigger)


@contextmanager
def _settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for as long as a stream starts; they are as before afterwards, also if it fails to start."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextmanager
def state_settings(spark: SparkSession, state_partitions: int | None = None) -> Iterator[None]:
    """Settings with which a stream starts. The number of state partitions is fixed when it first does, as nothing coalesces
    them later; it is the number of cores unless given."""
    partitions = str(state_partitions or spark.sparkContext.defaultParallelism)
    with _settings(spark, {"spark.sql.streaming.stateStore.providerClass": _ROCKSDB, "spark.sql.shuffle.partitions": partitions}):
        yield


def run_to_end(stream: DataFrame, base: str, state_partitions: int | None = None) -> DataFrame:
    """Process what is available into a parquet sink below ``base`` (exactly once) and read the sink.

    A second run with the same ``base`` goes on from its checkpoint, after a failure or with new files.
    """
    spark = prepare(stream.sparkSession)
    with state_settings(spark, state_partitions):
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{base}/checkpoint")
            .option("path", f"{base}/sink")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/sink")


def run_available(stream: DataFrame, name: str, state_partitions: int | None = None) -> DataFrame:
    """``run_to_end`` in a new folder."""
    return run_to_end(stream, scratch_path(stream.sparkSession, f"stream-{name}"), state_partitions)


def state_of(spark: SparkSession, base: str, variable: str) -> DataFrame:
    """The entries of a state variable in the last checkpoint of a run."""
    return spark.read.format("statestore").option("path", f"{base}/checkpoint").option("stateVarName", variable).load()
