"""Choosing rows for generation and training, shaping generated rows, and keeping content out of reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.constants import CONTENT_KEYS
from millrace.functions import exprs


def interleave(rows: DataFrame, first: Column, second: Column, order: list[str], most: int) -> DataFrame:
    """A row of each class in turn, up to most; then what is left of the first class, then of the second. Adds place (from 1)."""
    group = F.when(first, 0).when(second, 1)
    r = rows.withColumn("_g", group).where("_g is not null").withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy(*order))).where(F.col("_n") <= most)
    sizes = r.groupBy().agg(F.least(F.count_if(F.col("_g") == 0), F.count_if(F.col("_g") == 1)).alias("_z"))
    r = r.crossJoin(F.broadcast(sizes))  # one row
    zipped = F.col("_n") <= F.col("_z")
    # at most two times most rows are left here
    place = Window.orderBy(F.when(zipped, 0).otherwise(1), F.when(zipped, F.col("_n")).otherwise(F.col("_g")), F.when(zipped, F.col("_g")).otherwise(F.col("_n")))
    return r.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).drop("_g", "_n", "_z")


def shortest(rows: DataFrame, length: Column, order: list[str], k: int, most: int | None = None) -> DataFrame:
    """The k shortest rows (within a budget, if given); ties in input order. A top-k, not a sort of all rows."""
    kept = rows.withColumn("_len", length)
    return (kept if most is None else kept.where(F.col("_len") <= most)).orderBy("_len", *order).limit(k).drop("_len")


def head(rows: DataFrame, order: list[str], n: int = 8) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def ceiling(rows: DataFrame, length: Column, most: int) -> DataFrame:
    """max_length and whether all are within the limit."""
    return rows.agg(F.max(length).alias("max_length"), F.coalesce(F.max(length) <= most, F.lit(True)).alias("within"))


def mean_loss(rows: DataFrame, loss: str, by: list[str] | None = None) -> DataFrame:
    """rows and mean_loss (null without rows)."""
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.avg(loss).alias("mean_loss"))


def generated_rows(rows: DataFrame, label: str, content: str = "content", latency: str = "latency_ms") -> DataFrame:
    """referenceId, modelLabel, content (the JSON object in the text, or the text), latencyMs, parseable."""
    found = exprs.first_json_object(F.col(content))
    parsed = F.try_parse_json(found)
    return rows.select(F.col("id").alias("referenceId"), F.lit(label).alias("modelLabel"), F.coalesce(F.to_json(parsed), F.col(content)).alias("content"), F.round(latency, 3).alias("latencyMs"), parsed.isNotNull().alias("parseableByGenerator"))


def generation_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows, parseable, total and average latency (3 decimals)."""
    total = F.coalesce(F.sum(F.col("latencyMs").cast("decimal(28,6)")), F.lit(0))
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if("parseable").alias("parseable"), F.round(total, 3).cast("double").alias("total_ms"), F.round(total / F.greatest(F.lit(1), F.count("*")), 3).cast("double").alias("avg_ms"))


def generate(rows: DataFrame, predict: Callable[[pd.Series], pd.Series], prompt: str = "prompt") -> DataFrame:
    """Adds content and latency_ms from a user's function over batches of prompts. No model comes with this library."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, content string, latency_ms double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for part in parts:
            began = time.perf_counter()
            content = predict(part[prompt])
            each = (time.perf_counter() - began) * 1000 / max(1, len(part))
            yield part.assign(content=content.to_numpy(), latency_ms=each)

    return rows.mapInPandas(run, schema)


def redact(json_text: Column, keys: list[str] | None = None) -> Column:
    """JSON text without the content keys, at any depth; what isn't JSON becomes null. Recursive, so an Arrow function."""
    names = frozenset(CONTENT_KEYS if keys is None else keys)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        import json

        def clean(v):
            if isinstance(v, dict):
                return {k: clean(x) for k, x in v.items() if k not in names}
            return [clean(x) for x in v] if isinstance(v, list) else v

        def one(s):
            try:
                return json.dumps(clean(json.loads(s)), separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return column.map(one)

    return run(json_text)


def compact_json(json_text: Column) -> Column:
    """The same JSON without white space, keys in input order (a VARIANT would sort them); 1.0 is written 1."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        import json

        def number(s: str):
            x = float(s)
            return int(x) if x.is_integer() and abs(x) < 2**53 else x

        def one(s):
            try:
                return json.dumps(json.loads(s, parse_float=number), separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return column.map(one)

    return run(json_text)
