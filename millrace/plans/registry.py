"""Registered queries: a DataFrame function and, where SQL can say the same, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(configure(spark), sf_dir)
        if sql:
            SQL[name] = sql
        return f

    return add


def spread(rows: DataFrame) -> DataFrame:
    """rows in as many parts as there are cores, if the scan gives fewer: a small file is one part, and what follows costs much a row.

    Larger tables have more parts than that and aren't shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
