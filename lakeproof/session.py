"""Session settings and the shared folder for checkpoints and written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()
_local: dict[str, str] = {}
_written: WeakKeyDictionary[DataFrame, tuple[str, dict]] = WeakKeyDictionary()


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on (all are per session, none needs a restart)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application: they import its functions by name."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="lakeproof-"), "lakeproof.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(PACKAGE):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only for local sessions without it."""
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _local:
        _local[application] = tempfile.mkdtemp(prefix="lakeproof-")
    return _local[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/lakeproof/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, **observed: Column) -> DataFrame:
    """Cut lineage through a table in the shared folder: losing executors then costs a re-read, not a re-run.

    ``observed`` are aggregates that are taken while writing; ``facts`` of the result holds their values.
    """
    path = scratch_path(df.sparkSession, "table")
    watch = Observation() if observed else None
    (df.observe(watch, *[c.alias(n) for n, c in observed.items()]) if watch else df).write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[table] = (path, watch.get if watch else {})
    return table


def facts(table: DataFrame) -> dict:
    """Values observed while a table was materialized."""
    return _written[table][1]


def discard(*tables: DataFrame | None) -> None:
    """Delete materialized tables that nothing reads any more, such as those of past rounds of a loop."""
    for table in tables:
        path, _ = _written.pop(table, (None, None)) if table is not None else (None, None)
        if path is not None:
            java = table.sparkSession._jvm
            target = java.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
