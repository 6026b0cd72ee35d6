"""Captures, chat rows, their files and reports: what the curation, validation and planning operators make of JSON built from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import exprs, variants
from millrace.operators import audit, curate, select_rows, smoke, validate
from millrace.plans.evaluation import by_rest, join
from millrace.plans.registry import query, spread, table
from millrace.session import shared_folder
from millrace.sources import jsonl

# captures: documents with planted reasons to leave them out

_NAMES = {"src0": "click", "src1": "hono", "src2": "ripgrep"}


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    ops = F.when(F.col("lang") == "fr", "map").when(F.col("lang") == "de", "revalidate").otherwise("review")
    repo = F.lit("other")
    for source, name in _NAMES.items():
        repo = F.when(F.col("source") == source, name).otherwise(repo)
    output = F.when(F.col("lang").isin("fr", "de"), '{"featureId":"x"}').otherwise(by_rest(i, 3, {0: '{"findings":[]}', 1: '{"findings":[1]}'}, '{"findings":[1,2]}'))
    rows = table(spark, sf_dir, "documents").select(
        i.alias("n"),
        join("c", i.cast("string")).alias("captureId"),
        F.lit("run").alias("captureRunId"),
        ops.alias("operation"),
        F.struct(repo.alias("projectName"), F.lit("head").alias("headSha")).alias("repo"),
        F.struct(F.lit("p").alias("name"), F.lit(None).cast("string").alias("model")).alias("provider"),
        F.when(i % 13 == 0, "rejected").when(i % 13 == 1, F.lit(None)).otherwise("accepted").alias("status"),
        F.when(i % 17 == 0, "schema-invalid").otherwise("schema-valid-operation-valid").alias("validationStatus"),
        F.struct((i % 7 == 0).alias("redacted"), F.when(i % 19 == 0, True).alias("metadataOnly")).alias("redactionState"),
        F.when(i % 23 == 0, "").otherwise(F.col("text")).alias("prompt"),
        F.when(i % 29 == 0, "null").otherwise(output).alias("acceptedJson"),
    )
    return rows.withColumn("acceptedOutput", F.try_parse_json("acceptedJson"))


_CAPTURES = """cap AS (SELECT doc_id AS n, text, CASE lang WHEN 'fr' THEN 'map' WHEN 'de' THEN 'revalidate' ELSE 'review' END AS op, CASE source WHEN 'src0' THEN 'click' WHEN 'src1' THEN 'hono' WHEN 'src2' THEN 'ripgrep' ELSE 'other' END AS repo,
      CASE WHEN lang IN ('fr', 'de') THEN '{"featureId":"x"}' ELSE (['{"findings":[]}', '{"findings":[1]}', '{"findings":[1,2]}'])[doc_id % 3 + 1] END AS output, CASE WHEN lang IN ('fr', 'de') THEN -1 ELSE doc_id % 3 END AS findings,
      CASE WHEN doc_id % 13 IN (0, 1) THEN 'non-accepted-status' WHEN doc_id % 17 = 0 THEN 'not-schema-valid-operation-valid' WHEN doc_id % 19 = 0 THEN 'metadata-only' WHEN doc_id % 23 = 0 OR coalesce(text, '') = '' THEN 'missing-prompt' WHEN doc_id % 29 = 0 THEN 'missing-accepted-output' END AS reason FROM documents),
    good AS (SELECT *, row_number() OVER (PARTITION BY repo, op ORDER BY n) - 1 AS ordinal FROM cap WHERE reason IS NULL),
    chat AS (SELECT *, CASE WHEN repo = 'ripgrep' AND op = 'review' THEN (CASE WHEN ordinal % 2 = 0 THEN 'validation' ELSE 'test' END) WHEN repo IN ('click', 'hono') THEN 'train' WHEN repo = 'ripgrep' THEN 'validation' ELSE 'test' END AS split FROM good)"""


@query(f"WITH {_CAPTURES} SELECT reason, count(*) AS rows FROM cap WHERE reason IS NOT NULL GROUP BY reason")
def q_capture_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.excluded_counts(captures(spark, sf_dir))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.curated(captures(spark, sf_dir), "n", "Return JSON.")


@query(
    f"""WITH {_CAPTURES} SELECT 'c' || n AS id, op AS operation, repo, split, md5('system:Return JSON.|user:' || text || '|assistant:' || output) AS messages_md5, strlen(text)::BIGINT AS prompt_bytes, strlen(output)::BIGINT AS assistant_bytes, findings::BIGINT AS findings,
      CASE WHEN op = 'review' THEN '' ELSE 'x' END AS feature, n % 7 = 0 AS redacted, false AS metadata_only, '' AS model, '' AS kind FROM chat"""
)
def q_curated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("metadata")
    said = F.md5(F.array_join(F.transform("messages", lambda x: join(x["role"], ":", x["content"])), "|"))
    return chat(spark, sf_dir).select(
        m["captureId"].alias("id"), m["operation"].alias("operation"), m["repo"].alias("repo"), "split", said.alias("messages_md5"), m["promptBytes"].cast("long").alias("prompt_bytes"), m["assistantBytes"].cast("long").alias("assistant_bytes"),
        m["findingCount"].cast("long").alias("findings"), m["featureId"].alias("feature"), m["redacted"].alias("redacted"), m["metadataOnly"].alias("metadata_only"), m["providerModel"].alias("model"), m["evalKind"].alias("kind"),
    )


@query(
    f"""WITH {_CAPTURES}, tri AS (SELECT DISTINCT doc_id FROM labels), own AS (SELECT chat.*, CASE WHEN op <> 'review' THEN 'other' WHEN findings = 0 THEN 'clean' ELSE 'nonempty' END AS class FROM chat JOIN tri ON chat.n = tri.doc_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY repo || ':' || op || ':c' || n) AS place FROM own)
    SELECT 'c' || n AS id, 'hard_boundary' AS split, 'hard_boundary' AS kind, 'kept' || n % 2 AS status, 'note 2' AS notes, true AS expected FROM o WHERE class = 'other' OR place <= CASE class WHEN 'clean' THEN 8 ELSE 18 END"""
)
def q_curated_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    i = F.col("doc_id")
    triage = labels.select(join("c", i.cast("string")).alias("captureId"), join("kept", (i % 2).cast("string")).alias("triageStatus"), F.lit(None).cast("string").alias("triageReviewerOrMethod"), F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"))
    triage = triage.withColumn("triageNotes", join("note ", F.col("ordinal").cast("string")))
    m = F.col("metadata")
    return curate.hard_boundary(chat(spark, sf_dir), triage).select(m["captureId"].alias("id"), "split", m["evalKind"].alias("kind"), m["triageStatus"].alias("status"), m["triageNotes"].alias("notes"), (m["expectedJsonParse"] & m["expectedSchemaValid"] & m["expectedEvidenceValid"]).alias("expected"))


@query(f"WITH {_CAPTURES}, g AS (SELECT unnest(['train', 'validation', 'test', 'hard_boundary', 'all']) AS split) SELECT split, (SELECT count(*) FROM chat WHERE op = 'map' AND (chat.split = g.split OR g.split = 'all')) AS rows FROM g")
def q_operation_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curate.operation_subset(chat(spark, sf_dir), "map")
    return curate.zero_filled(rows.unionByName(curate.all_rows(rows)), ["train", "validation", "test", "hard_boundary", "all"])


@query("""SELECT 'c' || doc_id AS id, CASE lang WHEN 'fr' THEN 'map' WHEN 'de' THEN 'revalidate' ELSE 'review' END AS operation, CASE source WHEN 'src0' THEN 'click' WHEN 'src1' THEN 'hono' WHEN 'src2' THEN 'ripgrep' ELSE 'other' END AS repo,
    CASE doc_id % 13 WHEN 0 THEN 'rejected' WHEN 1 THEN 'unknown' ELSE 'accepted' END AS status, CASE WHEN doc_id % 17 = 0 THEN 'schema-invalid' ELSE 'schema-valid-operation-valid' END AS validation_status, doc_id % 7 = 0 AS redacted, doc_id % 19 = 0 AS metadata_only FROM documents""")
def q_capture_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.capture_projection(captures(spark, sf_dir))


@query("""SELECT count(*) AS rows, count(*) FILTER (doc_id % 13 > 1) AS accepted, count(*) FILTER (doc_id % 13 = 0) AS rejected, count(*) FILTER (doc_id % 19 = 0) AS metadata_only, count(*) FILTER (doc_id % 7 = 0) AS redacted, count(*) FILTER (lang NOT IN ('fr', 'de')) AS review, count(*) FILTER (lang = 'fr') AS map, count(*) FILTER (lang = 'de') AS revalidate, count(*) FILTER (lang = 'de') > 0 AS passed FROM documents""")
def q_smoke_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captures(spark, sf_dir).select("status", "operation", F.col("redactionState.redacted").alias("redacted"), F.coalesce("redactionState.metadataOnly", F.lit(False)).alias("metadataOnly"))
    return smoke.smoke_report(smoke.capture_summary(rows), [0, 0])


# metadata of chat rows, with wrong and missing values, as the planner reads it


def metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    named = by_rest(k, 5, {0: '"repo":{"projectName":"p"}', 1: '"repo":{"name":"q"}', 2: '"repo":"r"', 3: '"repo":7'}, '"x":1')
    text = join('{"captureId":"c', (k % 50).cast("string"), '","operation":"', by_rest(k, 4, {0: "review", 1: "map", 2: "revalidate"}, "bogus"), '",', named, ',"findingCount":', by_rest(k, 3, {0: "2", 1: "1.5"}, '"2"'), ',"redacted":', by_rest(k, 2, {0: "true"}, '"true"'), ',"metadataOnly":null}')
    return spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))).select("k", variants.parse_strict(text).alias("metadata"))


_PLANNER = """m AS (SELECT c_custkey AS k, 'c' || c_custkey % 50 AS id, (['review', 'map', 'revalidate', 'unknown'])[c_custkey % 4 + 1] AS operation, (['p', 'q', 'r', 'unknown', 'unknown'])[c_custkey % 5 + 1] AS repo, CASE WHEN c_custkey % 3 = 0 THEN 2 END::BIGINT AS finding_count, c_custkey % 2 = 0 AS redacted, false AS metadata_only FROM customer)"""


@query(f"WITH {_PLANNER} SELECT id, operation, repo, finding_count, redacted, metadata_only, k FROM m")
def q_planner_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.planner_projection(metadata_rows(spark, sf_dir))


@query(f"WITH {_PLANNER}, o AS (SELECT *, row_number() OVER (PARTITION BY operation, id, repo ORDER BY k DESC) AS place FROM m) SELECT id, operation, repo, finding_count, redacted, metadata_only, k FROM o WHERE place = 1")
def q_planner_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.deduplicated(audit.planner_projection(metadata_rows(spark, sf_dir)), ["k"])


@query(f"WITH {_PLANNER}, g AS (SELECT DISTINCT repo FROM m) SELECT count(*) FILTER (repo <> 'unknown') AS known_repos, (SELECT count(*) FROM m WHERE repo = 'unknown') AS unknown_rows, (SELECT count(*) FROM m) AS total_rows FROM g")
def q_planner_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.repository_summary(audit.planner_projection(metadata_rows(spark, sf_dir)))


@query("""WITH c AS (SELECT p_partkey AS k, p_partkey % 10 AS review, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 7 END AS map FROM part)
    SELECT k, CASE WHEN k % 2 = 0 THEN k ELSE review + map END AS total, review, map, 0::BIGINT AS revalidate FROM c""")
def q_normalized_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    text = join('{"total":', by_rest(k, 2, {0: k.cast("string")}, "-1"), ',"byOperation":{"review":', (k % 10).cast("string"), ',"map":', F.when(k % 3 == 0, "1.5").otherwise((k % 7).cast("string")), ',"other":9}}')
    rows = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))).select("k", variants.parse_strict(text).alias("v"))
    return rows.select("k", audit.normalized_counts(F.col("v")).alias("c")).select("k", "c.*")


@query("""WITH g AS (SELECT greatest(0, 500 - count(*) FILTER (lang NOT IN ('fr', 'de'))) AS review, greatest(0, 100 - count(*) FILTER (lang = 'de')) AS revalidate, greatest(0, 25 - count(*) FILTER (lang = 'fr')) AS map FROM documents)
    SELECT unnest([1, 2, 3])::INTEGER AS rank, unnest(['review', 'revalidate', 'map']) AS operation, unnest([review, revalidate, map])::BIGINT AS gap, unnest([false, revalidate > 0, false]) AS blocked FROM g""")
def q_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = captures(spark, sf_dir).agg(*[F.count_if(F.col("operation") == o).alias(o) for o in ("review", "map", "revalidate")])
    return audit.priorities(audit.plan(spark, ops.select("*", F.lit(3).alias("known_repos"), F.lit(0).alias("nonempty"))))


# chat rows with faults, as the validator reads them


def chat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")

    def message(role: str, content: str) -> str:
        return f'{{"role": "{role}", "content": {content}}}'

    def row(*messages: str, meta: str = '"captureId": "c1", "operation": "review"') -> str:
        return f'{{"messages": [{", ".join(messages)}], "metadata": {{{meta}}}}}'

    first = (message("system", '"s"'), message("user", '"u"'))
    answer = message("assistant", r'"{\"findings\":[],\"inspected\":{}}"')
    texts = {
        1: "[1]",
        2: '{"metadata": {"captureId": "c1", "operation": "review"}}',
        3: row(first[0], answer),
        4: f'{{"messages": [{", ".join((*first, answer))}], "metadata": 5}}',
        5: row(*first, answer, meta='"captureId": "c1", "operation": "bogus"'),
        6: row(*first, answer, answer),
        7: row(*first, message("assistant", "7")),
        8: row(*first, message("assistant", '"no json"')),
        9: row(*first, message("assistant", r'"{\"findings\":{}}"')),
        10: row(*first, message("assistant", '"[]"')),
        11: row(*first, answer, meta='"captureId": "", "operation": "review", "extra": 1.0'),
    }
    raw = by_rest(k, 12, texts, row(*first, answer))
    rows = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))
    rows = rows.select(F.lit("d").alias("dataset"), by_rest(k, 3, {0: "train", 1: "test"}, "validation").alias("split"), k.alias("line"), raw.alias("raw"))
    return rows.withColumn("value", variants.parse_strict(F.col("raw")))


_FAULTS = """(CASE c_custkey % 12 WHEN 1 THEN ['record_type'] WHEN 2 THEN ['messages_missing', 'assistant_message_count'] WHEN 3 THEN ['message_role_missing'] WHEN 4 THEN ['metadata_missing', 'operation_missing', 'capture_id_missing']
      WHEN 5 THEN ['operation_not_allowed', 'unknown_operation_schema'] WHEN 6 THEN ['assistant_message_count'] WHEN 7 THEN ['assistant_content_type'] WHEN 8 THEN ['assistant_json_parse'] WHEN 9 THEN ['assistant_schema_field_type', 'assistant_schema_missing_field']
      WHEN 10 THEN ['assistant_schema_type'] WHEN 11 THEN ['capture_id_missing'] ELSE [] END)"""


@query(f"SELECT 'd' AS dataset, (['train', 'test', 'validation'])[c_custkey % 3 + 1] AS split, c_custkey AS line, unnest({_FAULTS}) AS code FROM customer")
def q_validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate_rows(chat_texts(spark, sf_dir), ["review", "map", "revalidate"])


_COMPACT = (
    """CASE c_custkey % 12 WHEN 1 THEN 'hash:' || sha256('[1]') WHEN 4 THEN 'hash:' || sha256('{"messages":[{"role":"system","content":"s"},{"role":"user","content":"u"},{"role":"assistant","content":"{\\"findings\\":[],\\"inspected\\":{}}"}],"metadata":5}') """
    """WHEN 11 THEN 'hash:' || sha256('{"messages":[{"role":"system","content":"s"},{"role":"user","content":"u"},{"role":"assistant","content":"{\\"findings\\":[],\\"inspected\\":{}}"}],"metadata":{"captureId":"","operation":"review","extra":1}}') ELSE 'capture:c1' END"""
)


@query(f"SELECT c_custkey AS line, {_COMPACT} AS key, substr(sha256({_COMPACT}), 1, 16) AS short FROM customer")
def q_record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of rows: the capture's id, else a digest of the row as JSON without white space, keys in input order."""
    rows = chat_texts(spark, sf_dir).withColumn("raw", select_rows.compact_json(F.col("raw")))
    return validate.keyed(rows).select("line", "key", exprs.stable_hash(F.col("key")).alias("short"))


# files


def files_of(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the suppliers in one file for each of two datasets and three splits, with bad and blank lines; and one file deeper down."""
    root = f"{shared_folder(spark)}/millrace-files-{uuid.uuid4().hex}"
    k = F.col("s_suppkey")
    text = F.when(k % 50 == 7, "not json").when(k % 50 == 9, " ").otherwise(join('{"k":', k.cast("string"), ',"name":"süß"}'))
    rows = table(spark, sf_dir, "supplier").select(k, text.alias("line"))
    for d in range(2):
        for s, name in enumerate(("train", "validation", "test")):
            jsonl.export_file(rows.where((k % 2 == d) & (k % 3 == s)), f"{root}/d{d}/{name}.jsonl", [k], F.col("line"))
    jsonl.export_file(rows.where("false"), f"{root}/d0/sub/train.jsonl", [k], F.col("line"))
    return root


def _path(column: str) -> Column:
    """Paths are written with one or three slashes after the scheme."""
    return F.regexp_replace(column, "^([a-z]+):/*", "$1:/")


_FILES = """s AS (SELECT s_suppkey AS k, 'd' || s_suppkey % 2 AS dataset, (['train', 'validation', 'test'])[s_suppkey % 3 + 1] AS split, s_suppkey % 50 = 9 AS blank, s_suppkey % 50 = 7 AS bad FROM supplier),
    n AS (SELECT *, row_number() OVER w AS line, count(*) FILTER (NOT blank) OVER (PARTITION BY dataset, split ORDER BY k) AS ordinal FROM s WINDOW w AS (PARTITION BY dataset, split ORDER BY k))"""


@query(f"WITH {_FILES} SELECT dataset, split, line, ordinal, bad AS error, CASE WHEN NOT bad THEN k END AS k FROM n WHERE NOT blank")
def q_jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written, found and read: each line with its number and its number among those that aren't blank."""
    root = files_of(spark, sf_dir)
    found = jsonl.discover(spark, root).where("direct")
    rows = jsonl.scan(spark, f"{root}/*/*.jsonl")
    named = found.select(_path("path").alias("path"), "dataset", "split")
    own = rows.withColumn("path", _path("file")).join(named, "path")
    return own.select("dataset", "split", F.col("line").cast("long").alias("line"), F.col("ordinal").cast("long").alias("ordinal"), "error", F.try_variant_get("value", "$.k", "long").alias("k"))


@query(f"""WITH {_FILES}, g AS (SELECT * FROM (VALUES ('d0'), ('d1'), ('d2')) a(dataset), (VALUES ('train'), ('validation'), ('test'), ('all')) b(split)), c AS (SELECT dataset, split, count(*) FILTER (NOT blank) AS lines, count(*) FILTER (bad) AS errors FROM n GROUP BY ALL)
    SELECT g.dataset, g.split, c.dataset IS NULL AS missing, coalesce(lines, 0) AS lines, coalesce(errors, 0) AS errors FROM g LEFT JOIN c ON g.dataset = c.dataset AND g.split = c.split""")
def q_expected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files asked for against those that are there, with their lines, read in one pass without numbers."""
    root = files_of(spark, sf_dir)
    grid = [(f"d{d}", s) for d in range(3) for s in ("train", "validation", "test", "all")]
    wanted = jsonl.expected_files(jsonl.discover(spark, root).where("direct"), spark, grid)
    lines = jsonl.scan_large(spark, [f"{root}/d0/*.jsonl", f"{root}/d1/*.jsonl"]).groupBy(_path("file").alias("file")).agg(F.count("*").alias("lines"), F.count_if("error").alias("errors"))
    return wanted.join(lines, _path("path") == F.col("file"), "left").select("dataset", "split", F.col("path").isNull().alias("missing"), F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("errors", F.lit(0)).alias("errors"))


@query(f"""WITH {_FILES}, a AS (SELECT split, line, CASE WHEN NOT bad THEN k END AS k, bad AS error FROM n WHERE dataset = 'd1' AND split <> 'validation' AND NOT blank) SELECT * FROM a
    UNION ALL SELECT 'validation', row_number() OVER (ORDER BY r_regionkey), r_regionkey, false FROM region""")
def q_split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset's splits from JSON lines and from Parquet."""
    root = files_of(spark, sf_dir)
    rows = jsonl.load_splits(spark, {"train": f"{root}/d1/train.jsonl", "test": [f"{root}/d1/test.jsonl"], "validation": f"{sf_dir}/region.parquet"})
    key = F.coalesce(F.try_variant_get("value", "$.k", "long"), F.try_variant_get("value", "$.r_regionkey", "long"))
    return rows.select("split", "line", key.alias("k"), "error")


@query("SELECT n_nationkey::BIGINT AS k, row_number() OVER (ORDER BY n_nationkey) AS ordinal, row_number() OVER (ORDER BY n_nationkey) * 2 - 1 AS line, n_name AS name FROM nation")
def q_jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of which every line must be JSON; blank lines between them count as lines only."""
    path = f"{shared_folder(spark)}/millrace-strict-{uuid.uuid4().hex}.jsonl"
    jsonl.export_file(table(spark, sf_dir, "nation"), path, [F.col("n_nationkey")], F.concat(F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))), F.lit("\n")))
    rows = jsonl.scan_strict(spark, path, "nations")
    return rows.select(F.try_variant_get("value", "$.k", "long").alias("k"), F.col("ordinal").cast("long").alias("ordinal"), F.col("line").cast("long").alias("line"), F.try_variant_get("value", "$.name", "string").alias("name"))


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price FROM orders")
def q_jsonl_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as part files of JSON lines, and read again without numbers."""
    folder = f"{shared_folder(spark)}/millrace-lines-{uuid.uuid4().hex}"
    jsonl.write_lines(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price")), folder)
    v = F.col("value")
    return jsonl.scan_large(spark, folder).select(F.try_variant_get(v, "$.o_orderkey", "long").alias("o_orderkey"), F.try_variant_get(v, "$.o_orderstatus", "string").alias("o_orderstatus"), F.try_variant_get(v, "$.price", "double").alias("price"))


_CARD = "'---' || chr(10) || 'pretty_name: Regions' || chr(10) || 'tags:' || chr(10) || '  - a' || chr(10) || '  - b' || chr(10) || '---' || chr(10) || chr(10) || '# regions' || chr(10) || chr(10) || '| fact | value |' || chr(10) || '| --- | --- |' || chr(10) || '| rows | ' || rows || ' |' || chr(10)"


@query(f"WITH c AS (SELECT count(*) AS rows, max(r_regionkey)::BIGINT AS last FROM region) SELECT rows, last, md5({_CARD}) AS card_md5 FROM c")
def q_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report and a dataset card, written and read as whole files."""
    folder = f"{shared_folder(spark)}/millrace-report-{uuid.uuid4().hex}"
    report = table(spark, sf_dir, "region").agg(F.count("*").alias("rows"), F.max("r_regionkey").alias("last"))
    jsonl.export_report(report, f"{folder}/report.json")
    read = jsonl.document(spark, f"{folder}/report.json").select(*[F.try_variant_get("value", f"$.{n}", "long").alias(n) for n in ("rows", "last")])
    card = jsonl.dataset_card("regions", "Regions", {"rows": read.first()["rows"]}, ["a", "b"])
    jsonl.export_text(spark, f"{folder}/README.md", card)
    return read.crossJoin(spark.read.text(f"{folder}/README.md", wholetext=True).select(F.md5("value").alias("card_md5")))  # one row each


@query("WITH c AS (SELECT chr(97 + (s_suppkey % 5)::INTEGER) AS name FROM supplier) SELECT min(name) || '.json' AS path FROM c")
def q_first_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select(F.concat(F.chr(97 + F.col("s_suppkey") % 5), F.lit(".json")).alias("path"))
    return smoke.first_by_name(names)


# rows for generation and training


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 8")
def q_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_rows.head(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"])


@query("SELECT max(n_chars)::BIGINT AS max_length, coalesce(max(n_chars) <= 4096, true) AS within FROM documents")
def q_length_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_rows.ceiling(table(spark, sf_dir, "documents"), F.col("n_chars").cast("long"), 4096)


@query("SELECT event_type, count(*) AS rows, round(sum(value::DECIMAL(18, 4)) / count(*), 3)::DOUBLE AS mean_loss FROM events GROUP BY event_type")
def q_mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.col("value").cast("decimal(18,4)").alias("loss"))
    return select_rows.mean_loss(e, "loss", ["event_type"]).withColumn("mean_loss", F.round("mean_loss", 3).cast("double"))


@query("""WITH t AS (SELECT p_partkey AS k, range(1, (p_partkey % 9)::BIGINT + 1) AS ids, p_partkey % 11 AS n FROM part)
    SELECT k, array_to_string(CASE WHEN n >= len(ids) THEN list_transform(ids, lambda x: CASE WHEN x < len(ids) THEN -100 ELSE x END) ELSE list_transform(ids, lambda x: CASE WHEN x <= n THEN -100 ELSE x END) END, ',') AS labels FROM t""")
def q_mask_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("p_partkey") % 9).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(exprs.mask_labels(ids, (F.col("p_partkey") % 11).cast("int")), ",").alias("labels"))


@query("""WITH e AS (SELECT DISTINCT user_id, event_id // 100 AS k FROM events), g AS (SELECT *, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS island FROM e), r AS (SELECT user_id, min(k) AS a, max(k) AS b FROM g GROUP BY user_id, island)
    SELECT user_id, array_to_string(list(a || '-' || b ORDER BY a), ',') AS ranges FROM r GROUP BY user_id""")
def q_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's whole numbers as maximal ranges, inside the row."""
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.floor(F.col("event_id") / 100).cast("int")).alias("n"))
    shown = F.transform(exprs.ranges_of(F.col("n")), lambda r: join(r["first"].cast("string"), "-", r["last"].cast("string")))
    return own.select("user_id", F.array_join(shown, ",").alias("ranges"))


@query("""SELECT 'c' || c_custkey AS "referenceId", 'm' AS "modelLabel", CASE WHEN c_custkey % 3 = 0 THEN 'no object' ELSE '{"a":' || c_custkey || '}' END AS content, true AS timed, c_custkey % 3 <> 0 AS "parseableByGenerator" FROM customer""")
def q_generated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a generator: the JSON object in the text if there is one."""

    def predict(prompts):
        return prompts.map(lambda k: "no object" if int(k) % 3 == 0 else f'Sure: {{"a": {k}}} is the answer.')

    keys = table(spark, sf_dir, "customer").select(join("c", F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").cast("string").alias("prompt"))
    rows = select_rows.generated_rows(select_rows.generate(keys, predict), "m")
    return rows.select("referenceId", "modelLabel", "content", (F.col("latencyMs") >= 0).alias("timed"), "parseableByGenerator")
