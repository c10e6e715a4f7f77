"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _widened(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, so that results have the types of the checking engine."""
    ints = [f.name for f in df.schema.fields if f.dataType.simpleString() == "int"]
    return df.withColumns({c: F.col(f"`{c}`").cast("bigint") for c in ints}) if ints else df


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = wraps(fn)(lambda spark, sf_dir: _widened(fn(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """At least a partition for every core before heavy per-row work; a scan that has them is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
