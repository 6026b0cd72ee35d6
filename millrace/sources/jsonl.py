"""JSON Lines and report files as DataFrames.

Files of any size are split; `scan_large` reads them without line numbers, in one pass. A line that isn't JSON stays as a row
with error set, so that ordinals hold.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import exprs, variants


def scan(spark: SparkSession, paths: str | list[str], keep_blank: bool = False) -> DataFrame:
    """file, line (from 1), ordinal (among lines that aren't blank, from 1), raw, value (VARIANT), error.

    Files are split as usual. Lines are numbered within a split, and the numbers shifted by the counts of the file's splits before it.
    """
    read = spark.read.option("lineSep", "\n").text(paths)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", "\r\\z", "").alias("raw"))
    rows = rows.withColumn("_blank", exprs.blank(F.col("raw")))
    full = F.when(F.col("_blank"), 0).otherwise(1)
    counts = rows.groupBy("file", "_split").agg(F.count("*").alias("_lines"), F.sum(full).alias("_full"))
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("file", "_split", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_lines", "_full")])
    order = Window.partitionBy("file", "_split").orderBy("_at")
    rows = rows.withColumns({"_line": F.row_number().over(order), "_ordinal": F.sum(full).over(order)}).join(shift, ["file", "_split"])
    rows = rows if keep_blank else rows.where(~F.col("_blank"))
    value = variants.parse_strict(F.col("raw"))
    parsed = rows.select("file", (F.col("_lines") + F.col("_line")).alias("line"), (F.col("_full") + F.col("_ordinal")).alias("ordinal"), "raw", "_blank", value.alias("value"))
    return parsed.select("file", "line", "ordinal", "raw", "value", (F.col("value").isNull() & ~F.col("_blank")).alias("error"))


def scan_strict(spark: SparkSession, paths: str | list[str], label: str = "input") -> DataFrame:
    """As scan, but a line that isn't JSON fails the query, with its number among lines that aren't blank."""
    message = F.concat(F.lit(f"{label}: invalid JSON at row "), F.col("ordinal").cast("string"))
    rows = scan(spark, paths)
    return rows.withColumn("value", F.when(F.col("error"), F.raise_error(message).cast("variant")).otherwise(F.col("value"))).drop("error")


def scan_large(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, raw, value, error of lines that aren't blank, from splittable files."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")).where(~exprs.blank(F.col("value")))
    value = variants.parse_strict(F.col("raw"))
    return rows.select("file", "raw", value.alias("value"), value.isNull().alias("error"))


def load_splits(spark: SparkSession, files: dict[str, str | list[str]]) -> DataFrame:
    """split, file, line, ordinal, raw, value, error of the files of each split: a dataset as it lies in a folder. Parquet files come as one JSON text a row, numbered in file order."""
    out = None
    for split, paths in files.items():
        every = [paths] if isinstance(paths, str) else paths
        if all(p.endswith(".parquet") for p in every):
            read = spark.read.parquet(*every)
            text = read.select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.row_index") + 1).alias("line"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in read.columns])).alias("raw"))
            rows = text.select("file", "line", F.col("line").alias("ordinal"), "raw", variants.parse_strict(F.col("raw")).alias("value"), F.lit(False).alias("error"))
        else:
            rows = scan(spark, every)
        rows = rows.select(F.lit(split).alias("split"), "file", F.col("line").cast("long").alias("line"), F.col("ordinal").cast("long").alias("ordinal"), "raw", "value", "error")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("a dataset has a split at least")
    return out


def document(spark: SparkSession, path: str) -> DataFrame:
    """A whole file as one JSON value."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), variants.parse_strict(F.col("value")).alias("value"))


def discover(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """Files below root by name pattern: path, dataset (first folder below root), split (name without extension), direct (lies in that folder itself)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    scheme = "^[a-z]+:/*"  # paths come with their scheme, and with one slash after it or three
    top = re.sub(scheme, "/", root).rstrip("/")
    tail = F.substring(F.regexp_replace("path", scheme, "/"), F.lit(len(top) + 2), F.length("path"))
    parts = F.split(tail, "/")
    return found.select("path", F.element_at(parts, 1).alias("dataset"), F.regexp_extract(F.element_at(parts, -1), r"(.*)\.[^.]+$", 1).alias("split"), (F.size(parts) == 2).alias("direct")).orderBy("path")


def expected_files(found: DataFrame, spark: SparkSession, grid: list[tuple[str, str]]) -> DataFrame:
    """dataset, split, path (null: file_missing) of each expected pair."""
    return spark.createDataFrame(grid, "dataset string, split string").join(found.select("dataset", "split", "path"), ["dataset", "split"], "left")


def json_lines(rows: DataFrame, column: Column | None = None) -> DataFrame:
    return rows.select((F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])) if column is None else column).alias("value"))


def write_lines(rows: DataFrame, folder: str, column: Column | None = None) -> None:
    """Distributed sink: part files of one JSON text a line."""
    json_lines(rows, column).write.mode("overwrite").text(folder)


def export_file(rows: DataFrame, path: str, order: list[Column], column: Column | None = None) -> int:
    """One file in the given order, streamed through the driver to any file system that Spark can write; an empty set is a single line end."""
    n = 0
    with _Output(rows.sparkSession, path) as out:
        for r in json_lines(rows.orderBy(*order), column).toLocalIterator():
            out.write(r["value"] + "\n")
            n += 1
        if not n:
            out.write("\n")
    return n


class _Output:
    """A text file on the file system of its path, written in pieces of a megabyte."""

    def __init__(self, spark: SparkSession, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.stream = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
        self.held: list[bytes] = []
        self.size = 0

    def write(self, text: str) -> None:
        self.held.append(text.encode("utf-8"))
        self.size += len(self.held[-1])
        if self.size >= 1 << 20:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.stream.write(b"".join(self.held))
        self.held, self.size = [], 0

    def __enter__(self) -> _Output:
        return self

    def __exit__(self, *error: object) -> None:
        self.flush()
        self.stream.close()


def export_text(spark: SparkSession, path: str, text: str) -> None:
    with _Output(spark, path) as out:
        out.write(text)


def export_report(report: DataFrame, path: str) -> None:
    """A report of one row as one JSON document."""
    export_text(report.sparkSession, path, report.select(F.to_json(F.struct(*report.columns)).alias("j")).first()["j"] + "\n")


def dataset_card(name: str, title: str, facts: dict[str, object], tags: list[str]) -> str:
    """Markdown with front matter, and the facts as a table."""
    head = "\n".join(["---", f"pretty_name: {title}", "tags:", *[f"  - {t}" for t in tags], "---"])
    body = "\n".join(f"| {k} | {v} |" for k, v in facts.items())
    return f"{head}\n\n# {name}\n\n| fact | value |\n| --- | --- |\n{body}\n"
