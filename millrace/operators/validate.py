"""Row rules and identity rules of chat datasets, as issue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.constants import REQUIRED_FIELDS, SPLITS
from millrace.functions import exprs, variants
from millrace.functions.variants import field, items, kind, text


def _codes(*pairs: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in pairs]))


def required_fields(operation: Column, output: Column) -> Column:
    """Codes for an operation's required keys of the right kind."""
    out = F.array(F.lit("unknown_operation_schema"))
    for name, wanted in REQUIRED_FIELDS.items():
        each = [F.when(kind(field(output, k)) == "missing", "assistant_schema_missing_field").when(kind(field(output, k)) != t, "assistant_schema_field_type") for k, t in wanted.items()]
        own = F.when(kind(output) != "object", F.array(F.lit("assistant_schema_type"))).otherwise(F.array_compact(F.array(*each)))
        out = F.when(operation == name, own).otherwise(out)
    return out


def row_issues(row: Column, allowed: list[str]) -> Column:
    """Codes of one row (VARIANT). A row without messages also lacks its assistant message, one without metadata its fields."""
    messages, meta = field(row, "messages"), field(row, "metadata")
    every = items(messages)
    operation, capture = text(field(meta, "operation")), text(field(meta, "captureId"))
    roles = F.transform(every, lambda m: text(field(m, "role")))
    assistants = F.filter(every, lambda m: text(field(m, "role")) == "assistant")
    content = field(F.get(assistants, F.lit(0)), "content")
    output = variants.parse_strict(text(content))
    missing = [F.when((kind(messages) == "array") & ~F.array_contains(roles, r), "message_role_missing") for r in ("system", "user", "assistant")]
    base = _codes(("messages_missing", kind(messages) != "array"), ("metadata_missing", kind(meta) != "object"), ("operation_missing", F.coalesce(operation, F.lit("")) == ""), ("operation_not_allowed", (operation != "") & ~operation.isin(allowed)), ("capture_id_missing", F.coalesce(capture, F.lit("")) == ""))
    answer = (
        F.when(F.size(assistants) != 1, F.array(F.lit("assistant_message_count")))
        .when(kind(content) != "string", F.array(F.lit("assistant_content_type")))
        .when(output.isNull(), F.array(F.lit("assistant_json_parse")))
        .when(F.coalesce(operation, F.lit("")) == "", F.array().cast("array<string>"))
        .otherwise(required_fields(operation, output))
    )
    return F.when(kind(row) != "object", F.array(F.lit("record_type"))).otherwise(F.concat(base, F.array_compact(F.array(*missing)), answer))


def validate_rows(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """rows (dataset, split, line, value) to dataset, split, line, code."""
    return exprs.unnest(rows, row_issues(F.col("value"), allowed), "code", "dataset", "split", "line")


def keyed(rows: DataFrame) -> DataFrame:
    """Adds key: capture:<id> or hash:<digest of the row's text>. rows: value, raw."""
    capture = text(field(field(F.col("value"), "metadata"), "captureId"))
    return rows.withColumn("key", exprs.record_key(F.coalesce(capture, F.lit("")), F.col("raw")))


def consistency(rows: DataFrame) -> DataFrame:
    """Per dataset, in one pass over key counts: how many keys or rows break each identity rule. rows: dataset, split, key.

    Keys are counted by split first; then each key is one row with its counts, so no split is joined with another.
    """
    names = [*SPLITS, "all", "hard_boundary"]
    per_key = rows.groupBy("dataset", "key").agg(*[F.count_if(F.col("split") == s).alias(s) for s in names])
    regular = sum((F.col(s) for s in SPLITS[1:]), F.col(SPLITS[0]))
    return per_key.groupBy("dataset").agg(
        F.count_if(F.col("all") > 1).alias("all_duplicate_rows"),
        F.coalesce(F.sum(sum((F.when(F.col(s) > 1, 1).otherwise(0) for s in SPLITS[1:]), F.when(F.col(SPLITS[0]) > 1, 1).otherwise(0))), F.lit(0)).alias("split_duplicate_rows"),
        F.count_if(regular > 1).alias("regular_split_overlap"),
        F.coalesce(F.sum(F.when(F.col("all") == 0, regular).otherwise(0)), F.lit(0)).alias("regular_split_extra_rows"),
        F.coalesce(F.sum(F.when(regular == 0, F.col("all")).otherwise(0)), F.lit(0)).alias("regular_split_missing_rows"),
        F.coalesce(F.sum(F.when(F.col("all") == 0, F.col("hard_boundary")).otherwise(0)), F.lit(0)).alias("hard_boundary_extra_rows"),
        F.count_if(F.col("all") > 0).alias("distinct_all"),
    )


def key_histogram(values: DataFrame, value: str = "value") -> DataFrame:
    """key_set, rows: sorted top-level keys, or the kind's name."""
    return values.groupBy(variants.key_set(F.col(value)).alias("key_set")).agg(F.count("*").alias("rows"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """distinct_keys, duplicate_keys, rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.count("*").alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
