"""Text, path, JSON and windowing queries over documents, pages, events and part."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.constants import WINDOW_BYTES, WRAPPER_KEYS
from millrace.functions import exprs, variants
from millrace.operators import evaluate, prompt, select_rows, windowing
from millrace.plans.registry import query, table
from millrace.session import shared_folder


@query("SELECT doc_id, strlen(text)::BIGINT AS n_bytes, length(text)::BIGINT AS n_chars FROM documents")
def q_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", exprs.utf8_len(t).cast("long").alias("n_bytes"), F.char_length(t).cast("long").alias("n_chars"))


@query(r"SELECT doc_id, (length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')))::INTEGER AS units FROM documents")
def q_utf16_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", exprs.utf16_len(F.col("text")).alias("units"))


def _cut(source: str, column: str, most: int) -> str:
    """CTE parts that cut a column to whole characters within so many bytes: steps back from the end, never past the place."""
    return f"""steps AS (SELECT doc_id, {column} AS s, least(length({column}), {most}) AS m FROM {source} UNION ALL
      SELECT doc_id, s, m - greatest(1, ceil((strlen(left(s, m)) - {most}) / 4.0))::BIGINT FROM steps WHERE strlen(left(s, m)) > {most}),
    cut AS (SELECT doc_id, left(any_value(s), min(m)) AS cut FROM steps GROUP BY doc_id)"""


@query(f"WITH RECURSIVE {_cut('documents', 'text', WINDOW_BYTES)} SELECT doc_id, cut FROM cut")
def q_truncate_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", exprs.truncate_utf8(F.col("text"), WINDOW_BYTES).alias("cut"))


_NOTE = "'\n[Window note: prelude truncated to fit training budget.]\n'"
_UNITS = r"(length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')))"
_CLAMP = f"""RECURSIVE own AS (SELECT doc_id, lang, coalesce({_UNITS} > 4000, false) AS long, CASE WHEN {_UNITS} > 4000 AND length(text) > 4000 THEN left(text, 4000) || {_NOTE} ELSE text END AS s FROM documents),
    {_cut("own", "s", 4000)},
    done AS (SELECT own.doc_id, lang, long, CASE WHEN long THEN cut ELSE s END AS prompt FROM own JOIN cut USING (doc_id))"""


def clamped(docs: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<path:string,first:bigint,last:bigint>>")
    w = docs.select("doc_id", "lang", "text", windowing.window_prompt(F.col("text"), none).alias("w"))
    return w.select("doc_id", "lang", "w.prompt", "w.windowed", "w.strategy", exprs.utf8_len(F.col("text")).alias("n"))


@query(f"WITH {_CLAMP} SELECT doc_id, md5(prompt) AS prompt_md5, long AS windowed, CASE WHEN long THEN 'prompt-clamp-no-files-section' ELSE 'unchanged' END AS strategy FROM done")
def q_clamp_prelude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clamped(table(spark, sf_dir, "documents")).select("doc_id", F.md5("prompt").alias("prompt_md5"), "windowed", "strategy")


@query(f"WITH {_CLAMP} SELECT lang, CASE WHEN long THEN 'prompt-clamp-no-files-section' ELSE 'unchanged' END AS strategy, count(*) AS rows, count(*) FILTER (long) AS windowed_rows, max(strlen(prompt))::BIGINT AS max_bytes FROM done GROUP BY 1, 2")
def q_window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clamped(table(spark, sf_dir, "documents")).withColumn("bytes", F.octet_length("prompt").cast("long"))
    return windowing.window_summary(rows, ["lang", "strategy"])


_LINES = "lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)"


@query(f"WITH {_LINES} SELECT doc_id, n, md5(line) AS line_md5 FROM lines WHERE trim(line) <> ''")
def q_line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.where(~exprs.blank(F.col("line"))).select("doc_id", (F.col("at") + 1).cast("long").alias("n"), F.md5("line").alias("line_md5"))


@query(
    """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    f AS (SELECT doc_id, len(ls) AS m, ls, list_filter(range(1, len(ls) + 1), lambda i: contains(ls[i], 'the'))[1] AS hit FROM s)
    SELECT doc_id, hit, greatest(1, hit - 10) AS low, least(m, hit + 10) AS high, md5(array_to_string(list_transform(range(greatest(1, hit - 10), least(m, hit + 10) + 1), lambda i: i || ' | ' || ls[i]), chr(10))) AS window_md5 FROM f WHERE hit IS NOT NULL"""
)
def q_evidence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    block = F.struct(F.lit("p").alias("path"), F.lit("d").alias("descriptor"), F.transform(F.col("ls"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("text"), F.concat((i + 1).cast("string"), F.lit(" | "), x).alias("raw"))).alias("lines"))
    hit = F.array_position(F.transform("ls", lambda x: F.contains(x, F.lit("the"))), True)
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.alias("ls")).withColumn("hit", hit).where("hit > 0")
    evidence = F.array(F.struct(F.lit("p").alias("path"), F.col("hit").alias("first"), F.col("hit").alias("last")))
    text = F.get(windowing.evidence_snippets(F.array(block), evidence), F.lit(0))
    return docs.select("doc_id", "hit", F.greatest(F.lit(1), F.col("hit") - 10).alias("low"), F.least(F.size("ls"), F.col("hit") + 10).alias("high"), F.md5(F.regexp_replace(text, r"^--- p \(d\)\n", "")).alias("window_md5"))


@query(
    """WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, source FROM documents),
    r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM l)
    SELECT source, doc_id, least(n, greatest(0, 28 - before))::BIGINT AS kept FROM r WHERE before < 28"""
)
def q_line_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n"))
    # a text has a line at least, so the first 28 documents of a source use the budget up: the rest is cut before the shuffle
    first = docs.withColumn("at", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("at <= 28")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("before", before).where("before < 28").select("source", "doc_id", F.least("n", F.greatest(F.lit(0), 28 - F.col("before"))).cast("long").alias("kept"))


@query(
    """WITH e AS (SELECT DISTINCT user_id, event_type, event_id // 100 AS k FROM events), g AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, event_type ORDER BY k) AS island FROM e)
    SELECT user_id, event_type, min(k) AS first, max(k) AS last FROM g GROUP BY user_id, event_type, island"""
)
def q_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(F.col("event_id") / 100).alias("k")).distinct()
    g = e.withColumn("island", F.col("k") - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("k")))
    return g.groupBy("user_id", "event_type", "island").agg(F.min("k").alias("first"), F.max("k").alias("last")).drop("island")


@query(
    """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN props || ' x' WHEN 2 THEN '{''a'': 1}' WHEN 3 THEN '' ELSE '{"a":1}}' END AS s FROM events)
    SELECT event_id, json_valid(s) AND s <> '' AS ok FROM t"""
)
def q_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod("event_id", F.lit(5))
    s = F.when(k == 0, F.col("props")).when(k == 1, F.concat("props", F.lit(" x"))).when(k == 2, F.lit("{'a': 1}")).when(k == 3, F.lit("")).otherwise(F.lit('{"a":1}}'))
    return table(spark, sf_dir, "events").select("event_id", variants.is_json(s).alias("ok"))


@query(
    """SELECT CASE WHEN event_id % 3 = 0 THEN 'number' WHEN event_id % 3 = 1 THEN 'string' ELSE 'missing' END AS kind, count(*) AS n, sum(CASE WHEN event_id % 3 = 0 THEN (props->>'$.k')::BIGINT ELSE 0 END)::BIGINT AS total FROM events GROUP BY 1"""
)
def q_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod("event_id", F.lit(3))
    v = F.when(k == 0, F.try_parse_json("props")).when(k == 1, F.try_parse_json(F.regexp_replace("props", r": *(\d+)", ': "$1"'))).otherwise(F.try_parse_json(F.lit("{}")))
    f = variants.field(v, "k")
    return table(spark, sf_dir, "events").select(variants.kind(f).alias("kind"), variants.whole(f).alias("x")).groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("x"), F.lit(0)).alias("total"))


_PATH = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/', '')"


@query(f"WITH p AS (SELECT page_id, {_PATH} AS p FROM pages) SELECT page_id, p AS path, p <> '' AND NOT starts_with(p, '../') AND NOT starts_with(p, '/') AS safe, contains(p, '/') OR starts_with(p, '.') OR regexp_matches(p, '(?i)\\.[a-z0-9]+$') AS looks_like FROM p")
def q_safe_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "^/", "")
    return table(spark, sf_dir, "pages").select("page_id", exprs.normalize_path(raw).alias("path")).select("page_id", "path", exprs.safe_relative_path(F.col("path")).alias("safe"), exprs.path_like(F.col("path"), []).alias("looks_like"))


@query("""SELECT page_id, CASE WHEN strpos(html, '{') > 0 AND strpos(html, '}') > 0 AND length(html) - strpos(reverse(html), '}') + 1 >= strpos(html, '{') THEN md5(substr(html, strpos(html, '{'), length(html) - strpos(reverse(html), '}') + 2 - strpos(html, '{'))) ELSE '' END AS object_md5 FROM pages""")
def q_first_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.md5(exprs.first_json_object(F.col("html"))), F.lit("")).alias("object_md5"))


@query(
    """WITH t AS (SELECT doc_id, 'Valid evidence paths are exactly:' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE array_to_string(list_transform(range(doc_id % 4), lambda i: '- ./src/f' || i || '.py' || chr(10)), '') END || 'end' AS p FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN 'doc' || (doc_id % 7) || '.md' ELSE array_to_string(list_transform(range(doc_id % 4), lambda i: 'src/f' || i || '.py'), ',') END AS allowed FROM t"""
)
def q_allowed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 4)
    some = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.lit("- ./src/f"), i.cast("string"), F.lit(".py\n")))).otherwise(F.array().cast("array<string>"))
    text = F.concat(F.lit("Valid evidence paths are exactly:\n"), F.array_join(some, ""), F.lit("end"))
    docs = table(spark, sf_dir, "documents").select("doc_id").withColumn("p", text)
    included = F.array(F.concat(F.lit("./doc"), (F.col("doc_id") % 7).cast("string"), F.lit(".md")))
    allowed = prompt.allowed_paths(prompt.listed(F.col("p")), included, prompt.file_blocks(F.lit("")))
    return docs.select("doc_id", F.array_join(allowed, ",").alias("allowed"))


@query(f"SELECT p_partkey, p_partkey AS inner_key, CASE WHEN p_partkey % 11 = 8 THEN 'messages' WHEN p_partkey % 11 = 9 THEN 'choices' WHEN p_partkey % 11 = 10 THEN 'row' ELSE (['prediction', 'output', 'response', 'completion', 'generated_text', 'content', 'text', 'assistant'])[(p_partkey % 11) + 1] END AS source FROM part")
def q_prediction_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod("p_partkey", F.lit(11)).cast("int")
    inner = F.to_json(F.struct("p_partkey"))
    quoted = F.to_json(F.struct(inner.alias("x")))
    quoted = F.substring(quoted, 6, F.length(quoted) - 6)  # the JSON string without {"x": and }
    named = F.lit(None).cast("string")
    for i, name in enumerate(WRAPPER_KEYS):
        named = F.when(k == i, F.concat(F.lit('{"' + name + '":'), quoted if i % 2 else inner, F.lit("}"))).otherwise(named)
    text = F.when(k == 8, F.concat(F.lit('{"messages":[{"role":"assistant","content":'), quoted, F.lit("}]}"))).when(k == 9, F.concat(F.lit('{"choices":[{"message":{"content":'), quoted, F.lit("}}]}"))).when(k == 10, inner).otherwise(named)
    source = F.when(k == 8, "messages").when(k == 9, "choices").when(k == 10, "row").otherwise(F.get(F.array(*[F.lit(n) for n in WRAPPER_KEYS]), F.least(k, F.lit(7))))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.try_parse_json(text).alias("row"), source.alias("source"))
    return rows.select("p_partkey", F.try_variant_get(evaluate.unwrap(F.col("row")), "$.p_partkey", "long").alias("inner_key"), "source")


@query(
    """WITH n AS (SELECT s_nationkey AS k, list_sort(list('src/' || s_suppkey || '.py')) AS files FROM supplier GROUP BY 1)
    SELECT k AS nationkey, len(files)::BIGINT + 1 AS n_paths, md5(array_to_string(list_sort(files || ['README-' || k]), ',')) AS paths_md5 FROM n"""
)
def q_inventory_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.concat(F.lit("./src/"), F.col("s_suppkey"), F.lit(".py")).alias("path"), F.lit(1).alias("size"))).alias("files"))
    nested = F.to_json(F.struct(F.struct(F.col("files"), F.lit("just words").alias("note"), F.concat(F.lit("README-"), F.col("s_nationkey")).alias("top")).alias("tree")))
    text = F.concat(F.lit("Repository inventory:\n"), nested, F.lit("\n\nJSON shape: {}"))
    found = prompt.paths_in(prompt.walk_strings(F.col("v")))
    rows = s.select("s_nationkey", prompt.inventory(text).alias("v"))
    return rows.select(F.col("s_nationkey").alias("nationkey"), F.size(found).cast("long").alias("n_paths"), F.md5(F.array_join(found, ",")).alias("paths_md5"))


@query(r"""SELECT o_orderkey, regexp_replace(trim('  ' || replace(o_orderpriority, '-', chr(9) || ' ') || ' '), '\s+', ' ', 'g') AS compact, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS stamp, base64(encode(o_orderstatus || o_orderkey)) AS b64, CASE WHEN contains(o_orderpriority, 'LOW') THEN '<redacted>' ELSE o_orderpriority END AS argument FROM orders""")
def q_text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    padded = F.concat(F.lit("  "), F.regexp_replace("o_orderpriority", "-", "\t "), F.lit(" "))
    return o.select("o_orderkey", exprs.compact_whitespace(padded).alias("compact"), exprs.utc_stamp(F.col("o_orderdate")).alias("stamp"), exprs.base64_text(F.concat("o_orderstatus", "o_orderkey")).alias("b64"), exprs.redact_argument(F.col("o_orderpriority"), "LOW").alias("argument"))


@query("""SELECT event_id, '{"keep":{"k":' || (props->>'$.k') || '},"list":[{"id":1}]}' AS clean FROM events""")
def q_redact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.regexp_extract("props", r"(\d+)", 1)
    text = F.concat(F.lit('{"prompt": "secret", "keep": {"k": '), inner, F.lit(', "error": null}, "list": [{"messages": [1], "id": 1}]}'))
    return table(spark, sf_dir, "events").select("event_id", select_rows.redact(text).alias("clean"))


@query("SELECT doc_id, source, lang, row_number() OVER (ORDER BY source || ':' || lang || ':' || doc_id) AS place FROM documents")
def q_report_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.concat_ws(":", "source", "lang", "doc_id").alias("key"))
    # numbers in sort order without one task for all rows: ranges are counted, then numbered inside
    return numbered_by(d, "key").select("doc_id", "source", "lang", "place")


def numbered_by(rows: DataFrame, key: str) -> DataFrame:
    """place (from 1) by key.

    A distributed sort deals ranges of the full key to tasks, by sampled bounds; written as a table of the shared folder, its rows have a range and
    a place in it, and only the ranges' counts are ordered as a whole.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/millrace-sorted-{uuid.uuid4().hex}"
    rows.orderBy(key).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    shift = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(shift, "_range").withColumn("place", F.col("_before") + F.col("_at") + 1).drop("_id", "_range", "_at", "_before")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars <= 4096 ORDER BY n_chars, doc_id LIMIT 20")
def q_shortest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_rows.shortest(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("n_chars"), ["doc_id"], 20, 4096)


@query(
    """WITH r AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents)
    SELECT lang, max(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::BIGINT AS max_length, max(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) <= 600 AS within FROM r WHERE n <= 8 GROUP BY lang"""
)
def q_token_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    first = docs.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("n <= 8")
    length = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return first.groupBy("lang").agg(F.max(length).cast("long").alias("max_length"), (F.max(length) <= 600).alias("within"))


@query(
    """WITH c AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS n FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)),
    z AS (SELECT least(count(*) FILTER (quality = 1), count(*) FILTER (quality = 0)) AS z FROM c WHERE n <= 16),
    o AS (SELECT doc_id, quality, row_number() OVER (ORDER BY CASE WHEN n <= z THEN 0 ELSE 1 END, CASE WHEN n <= z THEN n ELSE 1 - quality END, CASE WHEN n <= z THEN 1 - quality ELSE n END) AS place FROM c, z WHERE n <= 16)
    SELECT doc_id, quality, place FROM o WHERE place <= 16"""
)
def q_interleave_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return select_rows.interleave(rows, F.col("quality") == 1, F.col("quality") == 0, ["doc_id"], 16).select("doc_id", "quality", F.col("place").cast("long").alias("place"))


@query("SELECT event_type, count(*) AS rows, count(*) FILTER (event_id % 3 <> 0) AS parseable, round(sum(round(value, 3)::DECIMAL(28, 6)), 3)::DOUBLE AS total_ms FROM events GROUP BY 1")
def q_generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.round("value", 3).alias("latencyMs"), (F.col("event_id") % 3 != 0).alias("parseable"))
    return select_rows.generation_summary(e, ["event_type"]).drop("avg_ms")
