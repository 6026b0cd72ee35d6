"""Captures as a stream of files, rolled up as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import variants


def read_stream(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """raw, value, error of the lines of files that arrive in a folder."""
    rows = spark.readStream.format("text").option("maxFilesPerTrigger", files_a_trigger).load(folder).select(F.col("value").alias("raw"))
    value = variants.parse_strict(F.col("raw"))
    return rows.where("length(trim(raw)) > 0").select("raw", value.alias("value"), value.isNull().alias("error"))


def status_counts(rows: DataFrame) -> DataFrame:
    """operation, status, rows: a running count (output mode complete or update)."""
    return rows.where("not error").groupBy(F.coalesce(F.try_variant_get("value", "$.operation", "string"), F.lit("unknown")).alias("operation"), F.coalesce(F.try_variant_get("value", "$.status", "string"), F.lit("unknown")).alias("status")).agg(F.count("*").alias("rows"))
