"""Registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeproof.session import prepare

QueryFn = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Lazy access to the parquet tables of one folder: ``t.orders`` reads ``orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, QueryFn] = {}
        self.oracles: dict[str, str] = {}

    def add(self, key: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        if key in self.queries:
            raise ValueError(f"query {key} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(prepare(spark), folder))

        run.__name__ = key
        self.queries[key] = run
        if sql is not None:
            self.oracles[key] = sql

    def query(self, key: str, sql: str | None = None):
        def register(build: Callable[[Tables], DataFrame]):
            self.add(key, build, sql)
            return build

        return register
