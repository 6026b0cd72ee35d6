"""Curation, validation and coverage over the driver's tables: documents stand for captures, labels for triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import exprs, variants
from millrace.operators import audit, curate, validate
from millrace.plans.registry import query, table

SPLITS_BY_SOURCE = {"src0": "train", "src1": "train", "src2": "validation"}
ALTERNATING = "src2"

_LABELED = """
labeled AS (
  SELECT d.doc_id, d.lang, d.source, d.text, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""
_SPLIT = """
ordered AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS ordinal FROM labeled),
split_rows AS (
  SELECT *, CASE WHEN source = 'src2' AND lang = 'en' THEN CASE WHEN ordinal % 2 = 0 THEN 'validation' ELSE 'test' END
    WHEN source IN ('src0', 'src1') THEN 'train' WHEN source = 'src2' THEN 'validation' ELSE 'test' END AS split
  FROM ordered)"""


def labeled(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", *columns)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return docs.join(labels, "doc_id", "left")


def split_column(ordinal: Column) -> Column:
    operation = F.when(F.col("lang") == "en", "review").otherwise(F.col("lang"))
    return curate.split_of(F.col("source"), operation, ordinal, SPLITS_BY_SOURCE, ALTERNATING)


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curate.with_ordinal_by_id(labeled(spark, sf_dir, "source", "lang"), ["source", "lang"], "doc_id")
    return rows.withColumn("split", split_column(F.col("ordinal")))


@query(f"WITH {_LABELED} SELECT CASE WHEN quality IS NULL THEN 'no-label' WHEN quality = 0 THEN 'low-quality' WHEN toxic = 1 THEN 'toxic' WHEN text IS NULL OR text = '' THEN 'empty-text' ELSE 'usable' END AS reason, count(*) AS n FROM labeled GROUP BY 1")
def q_usability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labeled(spark, sf_dir, "text")
    reason = curate.first_reason(("no-label", F.col("quality").isNull()), ("low-quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1), ("empty-text", F.col("text").isNull() | (F.col("text") == "")))
    return rows.groupBy(F.coalesce(reason, F.lit("usable")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_LABELED}, {_SPLIT} SELECT doc_id, ordinal, split FROM split_rows")
def q_split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rows(spark, sf_dir).select("doc_id", "ordinal", "split")


@query(
    f"""WITH {_LABELED}, {_SPLIT},
    s AS (SELECT split, lang, source, CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS facet,
      count(*) AS rows, count(*) FILTER (quality = 0) AS clean, count(*) FILTER (quality > 0) AS nonempty, count(*) FILTER (toxic = 1) AS redacted
      FROM split_rows GROUP BY GROUPING SETS ((split), (split, lang), (split, source)))
    SELECT split, facet, CASE facet WHEN 'lang' THEN lang WHEN 'source' THEN source ELSE '' END AS value, rows, clean, nonempty, redacted FROM s"""
)
def q_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_rows(spark, sf_dir).select("split", "lang", "source", F.coalesce("quality", F.lit(-1)).alias("findingCount"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("redacted"))
    return curate.split_summary(rows, ["lang", "source"])


@query(
    f"""WITH {_LABELED}, c AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS n FROM labeled WHERE quality IS NOT NULL)
    SELECT doc_id, quality, 'hard_boundary' AS kind FROM c WHERE n <= CASE WHEN quality = 0 THEN 8 ELSE 18 END"""
)
def q_hard_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labeled(spark, sf_dir).where("quality is not null")
    first = [rows.where(F.col("quality") == q).orderBy("doc_id").limit(n) for q, n in ((0, 8), (1, 18))]
    return first[0].union(first[1]).select("doc_id", "quality", F.lit("hard_boundary").alias("kind"))


@query(
    """WITH c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id)
    SELECT conv_id, len(m) AS n_messages, list_filter(m, lambda x: x.role = 'user')[1].text AS first_user, list_filter(m, lambda x: x.role = 'assistant')[-1].text AS last_assistant FROM c"""
)
def q_sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # first and last as minimum and maximum: a conversation of any length is summed up before the shuffle
    def own(role: str, column: str) -> Column:
        return F.when(F.col("role") == role, F.col(column))

    first, last = F.min_by(own("user", "text"), own("user", "turn")), F.max_by(own("assistant", "text"), own("assistant", "turn"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_messages"), first.alias("first_user"), last.alias("last_assistant"))


@query(
    """WITH c AS (SELECT conv_id, count(*) FILTER (role = 'system') AS s, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id),
    i AS (SELECT unnest([CASE WHEN s = 0 THEN 'message_role_missing:system' END, CASE WHEN u = 0 THEN 'message_role_missing:user' END, CASE WHEN a = 0 THEN 'message_role_missing:assistant' END, CASE WHEN a <> 1 THEN 'assistant_message_count' END]) AS code FROM c)
    SELECT code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY code"""
)
def q_message_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = ["system", "user", "assistant"]
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*[F.count_if(F.col("role") == r).alias(r) for r in roles])
    codes = F.array_compact(F.array(*[F.when(F.col(r) == 0, f"message_role_missing:{r}") for r in roles], F.when(F.col("assistant") != 1, "assistant_message_count")))
    return c.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_LABELED}, {_SPLIT}, grid AS (SELECT l.lang, s.split FROM (VALUES ('en'), ('de'), ('fr'), ('es'), ('it')) l(lang), (VALUES ('train'), ('validation'), ('test')) s(split))
    SELECT grid.lang, grid.split, count(split_rows.doc_id) AS rows FROM grid LEFT JOIN split_rows USING (lang, split) GROUP BY 1, 2"""
)
def q_operation_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(a, b) for a in ("en", "de", "fr", "es", "it") for b in ("train", "validation", "test")], "lang string, split string")
    counts = split_rows(spark, sf_dir).groupBy("lang", "split").agg(F.count("*").alias("rows"))
    return grid.join(counts, ["lang", "split"], "left").select("lang", "split", F.coalesce("rows", F.lit(0)).alias("rows"))


_DIGESTS = "d AS (SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1)"


@query(f"WITH {_DIGESTS} SELECT substr(key, 1, 16) AS fingerprint, n FROM d WHERE n > 1")
def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("n"))
    return keys.where("n > 1").select(F.substring("key", 1, 16).alias("fingerprint"), "n")


@query(f"WITH {_DIGESTS} SELECT count(*) AS distinct_keys, count(*) FILTER (n > 1) AS duplicate_keys, sum(n)::BIGINT AS rows FROM d")
def q_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicate_keys(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key")), "key")


_SEEDED = f"""{_LABELED}, {_SPLIT},
    seeded AS (
      SELECT split, 'k' || doc_id AS key FROM split_rows WHERE doc_id % 50 <> 1
      UNION ALL SELECT 'test', 'k' || doc_id FROM split_rows WHERE doc_id % 40 = 0
      UNION ALL SELECT 'all', 'k' || doc_id FROM split_rows WHERE doc_id % 60 <> 2
      UNION ALL SELECT 'all', 'k' || doc_id FROM split_rows WHERE doc_id % 90 = 3
      UNION ALL SELECT 'hard_boundary', 'k' || doc_id FROM split_rows WHERE quality = 1)"""


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all splits with planted faults: missing, extra, repeated and overlapping keys."""
    rows = split_rows(spark, sf_dir).select("split", "doc_id", "quality")
    parts = [("split", "doc_id % 50 <> 1"), ("'test'", "doc_id % 40 = 0"), ("'all'", "doc_id % 60 <> 2"), ("'all'", "doc_id % 90 = 3"), ("'hard_boundary'", "quality = 1")]
    picked = F.array_compact(F.array(*[F.when(F.expr(cond), F.expr(name)) for name, cond in parts]))
    return rows.select(F.explode(picked).alias("split"), F.concat(F.lit("k"), F.col("doc_id")).alias("key")).withColumn("dataset", F.lit("d"))


@query(
    f"""WITH {_SEEDED}, k AS (SELECT key, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'validation') AS b, count(*) FILTER (split = 'test') AS c, count(*) FILTER (split = 'all') AS l, count(*) FILTER (split = 'hard_boundary') AS h FROM seeded GROUP BY key)
    SELECT 'd' AS dataset, count(*) FILTER (l > 1) AS all_duplicate_rows, sum((a > 1)::INT + (b > 1)::INT + (c > 1)::INT)::BIGINT AS split_duplicate_rows, count(*) FILTER (a + b + c > 1) AS regular_split_overlap,
      coalesce(sum(a + b + c) FILTER (l = 0), 0)::BIGINT AS regular_split_extra_rows, coalesce(sum(l) FILTER (a + b + c = 0), 0)::BIGINT AS regular_split_missing_rows, coalesce(sum(h) FILTER (l = 0), 0)::BIGINT AS hard_boundary_extra_rows, count(*) FILTER (l > 0) AS distinct_all
    FROM k"""
)
def q_identity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.consistency(seeded(spark, sf_dir))


@query(
    f"""WITH {_SEEDED}, have AS (SELECT DISTINCT split FROM seeded WHERE split <> 'hard_boundary'),
    grid AS (SELECT unnest(['train', 'validation', 'test', 'hard_boundary', 'all']) AS split),
    counts AS (SELECT split, count(*) AS n, count(DISTINCT key) AS keys FROM seeded GROUP BY split)
    SELECT grid.split, have.split IS NULL AS file_missing, coalesce(n, 0) AS rows, coalesce(n - keys, 0) AS repeated FROM grid LEFT JOIN have USING (split) LEFT JOIN counts USING (split)"""
)
def q_dataset_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seeded(spark, sf_dir)
    counts = rows.groupBy("split", "key").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("rows"), (F.sum("n") - F.count("*")).alias("repeated"))
    grid = spark.createDataFrame([(s,) for s in ("train", "validation", "test", "hard_boundary", "all")], "split string")
    present = counts.where("split <> 'hard_boundary'").select("split", F.lit(True).alias("there"))
    return grid.join(present, "split", "left").join(counts, "split", "left").select("split", F.col("there").isNull().alias("file_missing"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("repeated", F.lit(0)).alias("repeated"))


_OPS = "CASE lang WHEN 'en' THEN 'review' WHEN 'fr' THEN 'map' WHEN 'de' THEN 'revalidate' ELSE 'unknown' END"


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("en", "review", "fr", "map", "de", "revalidate")])
    rows = split_rows(spark, sf_dir).withColumn("operation", names[F.col("lang")])
    return audit.audit_projection(rows, "operation", "split", "source", "quality", "doc_id")


_AUDIT = f"{_LABELED}, {_SPLIT}, audit AS (SELECT doc_id::VARCHAR AS id, {_OPS} AS operation, split, coalesce(source, 'unknown') AS repo, quality AS finding_count FROM split_rows)"


@query(f"WITH {_AUDIT} SELECT id, operation, split, repo, coalesce(finding_count, -1) AS finding_count FROM audit")
def q_audit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(spark, sf_dir).withColumn("finding_count", F.coalesce("finding_count", F.lit(-1)))


@query(
    f"""WITH {_AUDIT} SELECT operation, split, repo, count(*) AS rows, count(*) FILTER (finding_count = 0) AS clean, count(*) FILTER (finding_count > 0) AS nonempty, count(*) FILTER (finding_count IS NULL OR finding_count < 0) AS unknown
    FROM audit GROUP BY GROUPING SETS ((operation), (split), (repo), (operation, split, repo), ())"""
)
def q_coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coverage(audit_rows(spark, sf_dir))


@query(
    """SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"""
)
def q_dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the last row as a maximum: partial results before the shuffle, where a sorted window has none
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(last.alias("x")).select("user_id", "event_type", "x.event_id", F.round("x.value", 6).alias("value"))


@query(
    f"""WITH {_AUDIT}, t AS (SELECT * FROM (VALUES ('review', 500), ('revalidate', 100), ('map', 25)) t(operation, target)), c AS (SELECT operation, count(*) AS n FROM audit GROUP BY operation)
    SELECT t.operation, coalesce(n, 0) AS current, target::BIGINT AS target, greatest(0, target - coalesce(n, 0)) AS gap, coalesce(n, 0) >= target AS met FROM t LEFT JOIN c USING (operation)"""
)
def q_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.gaps(audit_rows(spark, sf_dir).groupBy("operation").agg(F.count("*").alias("rows")))


@query(
    f"""WITH {_AUDIT}, c AS (SELECT count(*) FILTER (operation = 'review') AS review, count(*) FILTER (operation = 'revalidate') AS revalidate, count(*) FILTER (operation = 'map') AS map, count(DISTINCT repo) FILTER (repo <> 'unknown') AS known, count(*) FILTER (finding_count > 0) AS nonempty FROM audit),
    g AS (SELECT greatest(0, 20000 - review) AS gr, greatest(0, 3000 - revalidate) AS gv, greatest(0, 1500 - map) AS gm, known, nonempty FROM c),
    r AS (SELECT *, (gv > 0 AND nonempty <= 0) AS blocked, ceil(gr / 43)::BIGINT AS r, CASE WHEN gv > 0 AND nonempty <= 0 THEN 0 ELSE ceil(gv / 16)::BIGINT END AS v FROM g),
    n AS (SELECT *, greatest(r, v, gm, greatest(0, 5 - known))::BIGINT AS new_repos FROM r),
    h AS (SELECT *, least(new_repos, greatest(r, v)) AS heavy FROM n)
    SELECT gr AS gap_review, gm AS gap_map, gv AS gap_revalidate, new_repos, heavy AS heavy_repos, new_repos - heavy AS map_only_repos, blocked AS revalidate_blocked,
      CASE WHEN heavy > 0 THEN gr // heavy ELSE 0 END AS review_min, CASE WHEN heavy > 0 THEN gr // heavy + (gr % heavy > 0)::INT ELSE 0 END AS review_max,
      CASE WHEN new_repos > 0 THEN gm // new_repos ELSE 0 END AS map_min, CASE WHEN new_repos > 0 THEN gm // new_repos + (gm % new_repos > 0)::INT ELSE 0 END AS map_max,
      CASE WHEN heavy > 0 THEN gv // heavy ELSE 0 END AS revalidate_min, CASE WHEN heavy > 0 THEN gv // heavy + (gv % heavy > 0)::INT ELSE 0 END AS revalidate_max
    FROM h"""
)
def q_plan_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = audit_rows(spark, sf_dir).groupBy("operation", "repo").agg(F.count("*").alias("n"), F.count_if(F.col("finding_count") > 0).alias("some"))
    ops = [F.coalesce(F.sum(F.when(F.col("operation") == o, F.col("n"))), F.lit(0)).alias(o) for o in ("review", "revalidate", "map")]
    goals = [F.lit(n).alias(f"t_{o}") for o, n in (("review", 20000), ("revalidate", 3000), ("map", 1500))]
    current = counts.agg(*ops, F.count_distinct(F.when(F.col("repo") != "unknown", F.col("repo"))).alias("known_repos"), F.coalesce(F.sum("some"), F.lit(0)).alias("nonempty")).select("*", *goals)
    return audit.plan(spark, current)


@query(
    """WITH o AS (SELECT o_orderstatus, o_orderpriority, o_totalprice > 200000 AS large FROM orders),
    g AS (SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS facet, o_orderstatus, o_orderpriority, count(*) AS rows, count(*) FILTER (large) AS large FROM o GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority)))
    SELECT facet, CASE WHEN facet = 'o_orderstatus' THEN o_orderstatus ELSE o_orderpriority END AS value, rows, large FROM g"""
)
def q_capture_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_totalprice") > 200000).alias("large"))
    return audit.capture_rollup(rows, ["o_orderstatus", "o_orderpriority"], ["large"])


@query("SELECT count(DISTINCT o_custkey) FILTER (o_custkey % 10 <> 0 AND o_custkey % 11 <> 0) AS known_repos, count(*) FILTER (o_custkey % 10 = 0 OR o_custkey % 11 = 0) AS unknown_rows, count(*) AS total_rows FROM orders")
def q_repository_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    repo = F.when(k % 10 == 0, F.lit(None)).when(k % 11 == 0, "").otherwise(k.cast("string"))
    return audit.repository_summary(table(spark, sf_dir, "orders").select(repo.alias("repo")))


@query("SELECT CASE WHEN event_id % 4 = 0 THEN 'id,kind,value' WHEN event_id % 4 = 1 THEN 'id,kind' WHEN event_id % 4 = 2 THEN 'array' ELSE 'number' END AS key_set, count(*) AS rows FROM events GROUP BY 1")
def q_key_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.pmod("event_id", F.lit(4))
    text = F.when(kind == 0, F.to_json(F.struct(F.col("value"), F.col("event_id").alias("id"), F.col("event_type").alias("kind")))).when(kind == 1, F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("event_id").alias("id")))).when(kind == 2, F.lit("[1,2]")).otherwise(F.lit("5"))
    return validate.key_histogram(e.select(variants.parse_strict(text).alias("value")))


@query(
    """SELECT event_id, coalesce(nullif(event_type, ''), 'unknown') AS label, CASE WHEN event_id % 3 = 0 THEN 'c' || event_id WHEN event_id % 3 = 1 THEN 'f' || user_id ELSE 'row-' || event_id END AS id,
    coalesce((props->>'$.k')::BIGINT, 0) AS k, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS finding_count FROM events"""
)
def q_metadata_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    v = F.try_parse_json("props")
    ident = exprs.first_id(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), F.col("event_id"))), F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("f"), F.col("user_id"))), ordinal=F.col("event_id"))
    output = F.when(F.col("event_id") % 2 == 0, F.parse_json(F.lit('{"findings":[1]}'))).otherwise(F.parse_json(F.lit('{"findings":null}')))
    return e.select("event_id", exprs.safe_label(F.col("event_type")).alias("label"), ident.alias("id"), exprs.number_or_zero(F.try_variant_get(v, "$.k", "long")).alias("k"), curate.finding_count(output).alias("finding_count"))
