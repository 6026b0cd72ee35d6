"""Windowing of chat rows made from part: prompts with and without files, by the four strategies, and blocks and lines of their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import exprs, variants
from millrace.operators import prompt, windowing
from millrace.plans.evaluation import by_rest, join
from millrace.plans.registry import query, spread, table

_LINES = 200


def _numbered(k: Column) -> Column:
    """The file src/a.py of a row: 200 numbered lines, one that isn't, and letters beyond ASCII in them."""
    between = [" ✓\n" * (i > 1) + f"{i} | líne {i} of " for i in range(1, _LINES + 1)]
    # the key stands once in each line: what is around it is the same for all rows
    return join("--- src/a.py (excerpt, part)\n", F.call_function("array_join", F.array(*map(F.lit, [*between, " ✓"])), k.cast("string")), "\nno number here\n")


_SMALL = "--- src/b.py (whole)\n1 | uno\n2 |dos\n3 | tres\n"


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, messages, metadata. What a prompt is follows from k % 6."""
    k = F.col("p_partkey")
    files = {3: join("Prompt ", k.cast("string"), "\nFiles:\n", _numbered(k), _SMALL), 4: join("Clean.\nFiles:\n", _SMALL, _numbered(k)), 5: join(F.repeat(F.lit("y"), 4500), "\nFiles:\n", _numbered(k), _SMALL)}
    middle = join(F.repeat(F.lit("h"), 3000), "\nJSON shape: {}", F.repeat(F.lit("t"), 1000 + (k % 2000).cast("int")))
    text = by_rest(k, 6, {1: join(F.repeat(F.lit("ä"), 1000), F.repeat(F.lit("x"), 3500 + (k % 100).cast("int"))), 2: middle, **files}, join("tiny prompt ", k.cast("string")))
    evidence = '{"path":"src/a.py","startLine":30,"endLine":32},{"path":"src/a.py","startLine":30.0,"endLine":31},{"path":"zzz.py","startLine":1,"endLine":2},{"path":5,"startLine":1},{"path":"src/b.py","startLine":null,"endLine":null}'
    near_top = '{"path":"src/a.py","startLine":3,"endLine":7},{"path":"src/a.py","startLine":5,"endLine":7}'
    found = lambda e: f'{{"findings":[{{"evidence":[{e}]}},{{"evidence":7}}]}}'
    output = by_rest(k, 6, {3: F.when(k % 4 == 1, found(near_top)).otherwise(found(evidence)), 5: found(evidence)}, '{"findings":[]}')
    messages = F.array(*[F.struct(F.lit(role).alias("role"), (F.lit(c) if isinstance(c, str) else c).alias("content")) for role, c in (("system", "s"), ("user", text), ("assistant", output))])
    meta = F.struct(F.lit("review").alias("operation"), F.when(k % 5 == 0, k.cast("int")).alias("promptBytes"))
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select(k.alias("k"), messages.alias("messages"), meta.alias("metadata"))


_NOTES = """notes AS (SELECT chr(10) || '[Window note: prelude truncated to fit training budget.]' || chr(10) AS cut, chr(10) || '[Window note: middle prompt context omitted to fit training budget.]' || chr(10) AS mid, chr(10) || '[Window note: trailing file context omitted to fit training budget.]' || chr(10) AS trail)"""
_WINDOWS = f"""{_NOTES},
    f AS (SELECT p_partkey AS k, list_transform(range(1, {_LINES + 1}), lambda i: i || ' | líne ' || i || ' of ' || p_partkey || ' ✓') AS ls, '--- src/a.py (excerpt, part)' || chr(10) AS head, '--- src/b.py (whole)' || chr(10) || '1 | uno' || chr(10) || '2 |dos' || chr(10) || '3 | tres' AS b FROM part),
    t AS (SELECT *, head || array_to_string(ls, chr(10)) || chr(10) || 'no number here' || chr(10) AS a FROM f),
    p AS (SELECT *, CASE k % 6 WHEN 1 THEN repeat('ä', 1000) || repeat('x', (3500 + k % 100)::BIGINT) WHEN 2 THEN repeat('h', 3000) || chr(10) || 'JSON shape: {{}}' || repeat('t', (1000 + k % 2000)::BIGINT)
        WHEN 3 THEN 'Prompt ' || k || chr(10) || 'Files:' || chr(10) || a || b || chr(10) WHEN 4 THEN 'Clean.' || chr(10) || 'Files:' || chr(10) || b || chr(10) || a WHEN 5 THEN repeat('y', 4500) || chr(10) || 'Files:' || chr(10) || a || b || chr(10) ELSE 'tiny prompt ' || k END AS text FROM t),
    w AS (SELECT p.*, CASE k % 6 WHEN 1 THEN left(text, 3000) WHEN 2 THEN (CASE WHEN length(text) <= 4000 THEN text ELSE left(left(text, 2200) || mid || substr(text, greatest(3001, length(text) - 1800 + 1)), 4000) END)
        WHEN 3 THEN 'Prompt ' || k || chr(10) || 'Files:' || chr(10) || (CASE WHEN k % 4 = 1 THEN head || array_to_string(ls[1:17], chr(10)) ELSE head || array_to_string(ls[20:42], chr(10)) || chr(10) || chr(10) || head || array_to_string(ls[20:41], chr(10)) || chr(10) || chr(10) || b END) || chr(10)
        WHEN 4 THEN 'Clean.' || chr(10) || 'Files:' || chr(10) || b || chr(10) || chr(10) || head || array_to_string(ls[1:25], chr(10)) || chr(10)
        WHEN 5 THEN left(repeat('y', 4000) || cut, 4000 - strlen(trail)) || trail ELSE text END AS prompt,
      CASE WHEN length(text) <= 4000 THEN 'unchanged' WHEN k % 6 IN (1, 2) THEN 'prompt-clamp-no-files-section' WHEN k % 6 = 4 THEN 'clean-review-head-file-window' ELSE 'evidence-centered-file-window' END AS strategy,
      CASE WHEN length(text) <= 4000 THEN -1 WHEN k % 6 IN (1, 2) THEN 0 WHEN k % 6 = 4 THEN 2 WHEN k % 6 = 3 AND k % 4 = 1 THEN 1 ELSE 3 END AS blocks FROM p, notes)"""


@query(
    f"""WITH {_WINDOWS} SELECT k, md5(prompt) AS prompt_md5, strategy <> 'unchanged' AS windowed, strategy, blocks::INTEGER AS blocks, greatest(0, length(text) - length(prompt))::INTEGER AS omitted, CASE WHEN k % 5 = 0 THEN k ELSE strlen(text) END::INTEGER AS original_bytes, strlen(prompt)::INTEGER AS window_bytes,
      CASE WHEN k % 5 = 0 THEN k ELSE -1 END::INTEGER AS prompt_bytes, 3::INTEGER AS n_messages FROM w"""
)
def q_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("metadata")
    return windowing.window_rows(chat_rows(spark, sf_dir)).select(
        "k",
        F.md5(F.get("messages", F.lit(1))["content"]).alias("prompt_md5"),
        m["windowed"].alias("windowed"),
        m["windowStrategy"].alias("strategy"),
        m["retainedFileBlocks"].alias("blocks"),
        m["omittedPromptChars"].alias("omitted"),
        m["originalPromptBytes"].alias("original_bytes"),
        m["windowPromptBytes"].alias("window_bytes"),
        F.coalesce(m["promptBytes"], F.lit(-1)).alias("prompt_bytes"),
        F.size("messages").alias("n_messages"),
    )


@query(f"WITH {_WINDOWS} SELECT 'review' AS operation, strategy, count(*) AS rows, count(*) FILTER (strategy <> 'unchanged') AS windowed_rows, max(strlen(prompt))::INTEGER AS max_bytes FROM w GROUP BY strategy")
def q_window_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("metadata")
    rows = windowing.window_rows(chat_rows(spark, sf_dir)).select(m["operation"].alias("operation"), m["windowStrategy"].alias("strategy"), m["windowed"].alias("windowed"), m["windowPromptBytes"].alias("bytes"))
    return windowing.window_summary(rows, ["operation", "strategy"])


def file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_rows(spark, sf_dir).select("k", windowing.split_files(F.get("messages", F.lit(1))["content"]).alias("s"))
    return rows.select("k", F.col("s.prelude").alias("prelude"), prompt.file_blocks(F.col("s.files")).alias("blocks"))


@query(
    f"""WITH {_WINDOWS} SELECT k, CASE WHEN k % 6 = 4 THEN 0 ELSE 1 END::BIGINT AS place, 'src/b.py' AS path, 'whole' AS descriptor, 3::BIGINT AS lines, 'uno|dos|tres' AS texts, md5(CASE k % 6 WHEN 3 THEN 'Prompt ' || k WHEN 4 THEN 'Clean.' ELSE repeat('y', 4500) END || chr(10) || 'Files:' || chr(10)) AS prelude_md5 FROM p WHERE k % 6 >= 3
    UNION ALL SELECT k, CASE WHEN k % 6 = 4 THEN 1 ELSE 0 END, 'src/a.py', 'excerpt, part', {_LINES}, 'líne 1 of ' || k || ' ✓', md5(CASE k % 6 WHEN 3 THEN 'Prompt ' || k WHEN 4 THEN 'Clean.' ELSE repeat('y', 4500) END || chr(10) || 'Files:' || chr(10)) FROM p WHERE k % 6 >= 3"""
)
def q_file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each prompt's blocks in order, with their numbered lines."""
    rows = file_blocks(spark, sf_dir).select("k", "prelude", F.posexplode_outer("blocks").alias("place", "b")).where("b is not null")
    first = F.array_join(F.transform(F.slice(F.col("b.lines"), 1, F.when(F.col("b.path") == "src/b.py", 3).otherwise(1)), lambda x: x["text"]), "|")
    return rows.select("k", F.col("place").cast("long").alias("place"), "b.path", "b.descriptor", F.size("b.lines").cast("long").alias("lines"), first.alias("texts"), F.md5("prelude").alias("prelude_md5"))


@query(
    """WITH e AS (SELECT p_partkey AS k, unnest(CASE WHEN p_partkey % 6 = 3 AND p_partkey % 4 = 1 THEN [{'p': 'src/a.py', 'a': 3, 'b': 7}, {'p': 'src/a.py', 'a': 5, 'b': 7}]
      WHEN p_partkey % 6 IN (3, 5) THEN [{'p': 'src/a.py', 'a': 30, 'b': 32}, {'p': 'src/a.py', 'a': 30, 'b': 31}, {'p': 'zzz.py', 'a': 1, 'b': 2}, {'p': 'src/b.py', 'a': 1, 'b': 1}] ELSE [] END) AS x FROM part)
    SELECT k, x.p AS path, x.a::BIGINT AS first, x.b::BIGINT AS last FROM e"""
)
def q_evidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = variants.parse_strict(F.element_at("messages", -1)["content"])
    return exprs.unnest(chat_rows(spark, sf_dir), windowing.evidence_list(output), "x", "k").select("k", "x.path", F.col("x.first").cast("long").alias("first"), F.col("x.last").cast("long").alias("last"))
