"""Registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The input tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _plain_types(df: DataFrame) -> DataFrame:
    """Integers as long, so that both engines report one integer type."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(
        *[
            F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, small) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None):  # noqa: ANN201
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its checking SQL."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: _plain_types(fn(Tables(spark, folder)))
        if sql:
            ORACLES[name] = sql
        return fn

    return register
