"""What surrounds a live run: capture counts, the report on it, and argument handling. Running programs is left to the caller."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.constants import OPERATIONS


def capture_summary(captures: DataFrame) -> DataFrame:
    """One row: captures by status, flags and operation; zeros for an empty table. captures: status, operation, redacted, metadataOnly."""
    return captures.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if("metadataOnly").alias("metadata_only"),
        F.count_if("redacted").alias("redacted"),
        *[F.count_if(F.col("operation") == o).alias(o) for o in OPERATIONS],
    )


def smoke_report(summary: DataFrame, exit_codes: list[int]) -> DataFrame:
    """The summary with passed: every step ended with 0 and a revalidate capture is there."""
    return summary.withColumn("passed", F.lit(all(c == 0 for c in exit_codes)) & (F.col("revalidate") > 0))


def first_by_name(files: DataFrame, column: str = "path") -> DataFrame:
    """The first file in order of names, as a minimum."""
    return files.agg(F.min(column).alias(column))


def labeled_path(argument: str) -> tuple[str, str]:
    """label=path, or a path whose stem is the label."""
    label, found, path = argument.partition("=")
    return (label, path) if found and label else (PurePath(argument).stem, argument)


def missing(required: list[str], given: dict[str, str]) -> list[str]:
    """Names without a value; raise on any."""
    out = [n for n in required if not given.get(n)]
    if out:
        raise ValueError(f"missing: {', '.join(out)}")
    return out


def one_operation(rows: DataFrame, wanted: str | None = None) -> str:
    """The operation asked for, or the only one in rows; none or several raise. At most two values are read."""
    if wanted is not None:
        if wanted not in OPERATIONS:
            raise ValueError(f"unknown operation {wanted}")
        return wanted
    found = [r["operation"] for r in rows.where(F.col("operation").isin(OPERATIONS)).select("operation").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"expected one operation, found {found}")
    return found[0]
