"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bayes, bpe_codec, decontaminate, langid, packing, sharding, substring, token_tree, url_filter, va_file
from millrace.llm.common import table

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"))
    found = langid.identify(docs, learn=F.col("doc_id").isNotNull() & ~held, key=F.col("doc_id").cast("string"))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).drop("digest")


def planned_edits(doc_id: Column, text: Column) -> Column:
    """Three edits of every document, at places that follow from its id: a replacement, an insertion and a deletion."""
    length = F.coalesce(F.char_length(text), F.lit(0))

    def place(n: int) -> Column:
        return F.pmod(F.xxhash64(doc_id, F.lit(n)), length + 1).cast("int")

    def edit(n: int, delete: int, insert: str) -> Column:
        return F.struct(place(n).alias("place"), F.lit(delete).alias("delete"), F.lit(insert).alias("insert"))

    return F.array(edit(1, 12, " revised wording "), edit(2, 0, "(sic) it's 42"), edit(3, 25, ""))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", planned_edits(F.col("doc_id"), F.col("text")))
    return token_tree.count_edited(docs, vocabulary())


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bayes.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "is_first")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.digests(docs, vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, vocabulary())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "word")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sharding": op2_sharding,
    "op3_token_counts": op3_token_counts,
    "op4_top_k": op4_top_k,
    "op5_ngram_join": op5_ngram_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_bpe": op7_bpe,
    "op8_decontamination": op8_decontamination,
    "op9_url_filters": op9_url_filters,
    "op10_packing": op10_packing,
}

SQL: dict[str, str] = {
    "op4_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n FROM d),
s AS (SELECT doc_id, unnest(range(1, n - 18)) AS i, w, n FROM n),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(w[i:i + 19], ' ')) ORDER BY doc_id, i) AS seen FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM k WHERE seen > 1),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, n + 1)) AS i FROM n),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS t, count(*) AS c FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT n.doc_id, n.n AS n_words, n.n - coalesce(kept.c, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM n LEFT JOIN kept ON n.doc_id = kept.doc_id""",
    "op9_url_filters": r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
ruled AS (
  SELECT page_id, host, path,
    CASE
      WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/'
    END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
}
