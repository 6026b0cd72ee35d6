"""Shapes, evidence, matching, metrics, gates and triage over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.constants import STOP_WORDS
from millrace.functions import exprs, variants
from millrace.operators import evaluate, evidence, gate, match, shapes
from millrace.operators.evaluate import accumulate
from millrace.plans.registry import query, spread, table

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_TOKENS = f"list_filter(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: length(x) > 2)), lambda x: NOT list_contains({_STOP}, x))"


@query(
    f"""WITH p AS (SELECT p_partkey AS k, p_brand, {_TOKENS} AS w FROM part),
    j AS (SELECT a.k AS left_key, b.k AS right_key, len(list_intersect(a.w, b.w)) AS i, len(list_distinct(a.w || b.w)) AS u FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.k < b.k)
    SELECT left_key, right_key, CASE WHEN u = 0 THEN 0.0 ELSE round(i / u, 6) END AS score FROM j"""
)
def q_title_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("w", F.array_sort(exprs.title_tokens(F.concat("p_name", F.lit(" "), "p_type"))))
    return match.pairs_in_blocks(p, "p_partkey", ["p_brand"], "w", lambda a, b: F.round(exprs.jaccard(a, b), 6))


# lines of an order are findings: odd lines the reference's, even ones the prediction's
_FINDINGS = """f AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey % 400 AS first, l_partkey % 400 + l_quantity::BIGINT AS last, l_returnflag AS category, l_linestatus AS severity, l_suppkey % 3 AS path FROM lineitem),
    pairs AS (SELECT r.o, r.n AS r, p.n AS p, r.path = p.path AS same_path, r.category = p.category AS c, r.severity = p.severity AS s,
        least(r.last, p.last) - greatest(r.first, p.first) + 1 AS overlap, greatest(r.last - r.first + 1, p.last - p.first + 1, 1) AS longest, greatest(r.first, p.first) - least(r.last, p.last) AS gap
      FROM f r JOIN f p ON r.o = p.o AND r.n % 2 = 1 AND p.n % 2 = 0),
    scored AS (SELECT o, r, p, CASE WHEN NOT same_path THEN 0 WHEN overlap > 0 THEN 0.55::DOUBLE + least(0.15::DOUBLE, 0.15::DOUBLE * overlap / longest) WHEN gap <= 5 THEN 0.4::DOUBLE WHEN gap <= 20 THEN 0.25::DOUBLE ELSE 0.2::DOUBLE END AS ev, c, s FROM pairs),
    findings AS (SELECT o, r, p, round(ev, 6) AS evidence, round(least(1::DOUBLE, ev + CASE WHEN c THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN s THEN 0.1::DOUBLE ELSE 0 END), 6) AS score FROM scored)"""


def finding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("l_partkey") % 400
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.struct(F.col("l_linenumber").alias("n"), first.alias("first"), (first + F.col("l_quantity").cast("long")).alias("last"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("severity"), (F.col("l_suppkey") % 3).alias("path")).alias("x"))
    # an order's lines in one array: pairs are made inside the row, with one shuffle and no self-join
    own = f.groupBy("o").agg(F.filter(F.collect_list("x"), lambda x: x["n"] % 2 == 1).alias("r"), F.filter(F.collect_list("x"), lambda x: x["n"] % 2 == 0).alias("p"))

    def pair(r: Column, p: Column) -> Column:
        ev = match.pair_score(r["path"] == p["path"], r["first"], r["last"], p["first"], p["last"])
        score = match.finding_score(ev, F.lit(0.0), r["category"] == p["category"], r["severity"] == p["severity"])
        return F.struct(r["n"].alias("r"), p["n"].alias("p"), F.round(ev, 6).alias("evidence"), score.alias("score"))

    return own.select("o", F.flatten(F.transform("r", lambda r: F.transform("p", lambda p: pair(r, p)))).alias("pairs"))


@query(f"WITH {_FINDINGS} SELECT o, r, p, evidence, score FROM findings")
def q_finding_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exprs.unnest(finding_pairs(spark, sf_dir), F.col("pairs"), "x", "o").select("o", "x.*")


@query(f"WITH {_FINDINGS} SELECT o, max(evidence) AS best FROM findings GROUP BY o")
def q_best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding_pairs(spark, sf_dir).where("size(pairs) > 0").select("o", F.array_max(F.transform("pairs", lambda x: x["evidence"])).alias("best"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.filter("pairs", lambda x: x["score"] >= 0.55)
    return finding_pairs(spark, sf_dir).select("o", match.greedy(good).alias("m"))


@query(
    f"""WITH RECURSIVE {_FINDINGS},
    c AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY score DESC, p, r) AS i, r, p, score FROM findings WHERE score >= 0.55),
    walk AS (
      SELECT o, i, [r] AS rs, [p] AS ps, true AS took, r, p, score FROM c WHERE i = 1
      UNION ALL
      SELECT c.o, c.i, CASE WHEN NOT list_contains(w.rs, c.r) AND NOT list_contains(w.ps, c.p) THEN list_append(w.rs, c.r) ELSE w.rs END, CASE WHEN NOT list_contains(w.rs, c.r) AND NOT list_contains(w.ps, c.p) THEN list_append(w.ps, c.p) ELSE w.ps END,
        NOT list_contains(w.rs, c.r) AND NOT list_contains(w.ps, c.p), c.r, c.p, c.score
      FROM walk w JOIN c ON c.o = w.o AND c.i = w.i + 1)
    SELECT o, r, p, score FROM walk WHERE took"""
)
def q_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exprs.unnest(matches(spark, sf_dir), F.col("m"), "x", "o").select("o", "x.r", "x.p", "x.score")


# features: the parts of a supplier's nation against those one key further
_SETS = """s AS (SELECT l_suppkey AS k, list_sort(list(DISTINCT l_partkey % 40)) AS a, list_sort(list(DISTINCT l_partkey % 15)) AS b FROM lineitem GROUP BY 1),
    j AS (SELECT x.k AS r, y.k AS p, len(list_intersect(x.a, y.a)) / len(list_distinct(x.a || y.a)) AS ja, len(list_intersect(x.b, y.b)) / len(list_distinct(x.b || y.b)) AS jb, len(x.b) = len(y.b) AND len(list_intersect(x.b, y.b)) = len(x.b) AS same FROM s x JOIN s y ON y.k = x.k + 1)"""


def feature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.col("l_partkey") % 40).alias("a"), F.collect_set(F.col("l_partkey") % 15).alias("b"))
    x, y = s.alias("x"), s.alias("y")
    both = x.join(y, F.col("y.l_suppkey") == F.col("x.l_suppkey") + 1)
    return both.select(F.col("x.l_suppkey").alias("r"), F.col("y.l_suppkey").alias("p"), F.when(exprs.same_set(F.col("x.b"), F.col("y.b")), "exact").otherwise("near").alias("kind"), match.feature_score(F.col("x.b"), F.col("y.b"), F.col("x.a"), F.col("y.a")).alias("score"))


@query(f"WITH {_SETS} SELECT r, p, CASE WHEN same THEN 'exact' ELSE 'near' END AS kind, round(greatest(jb, 0.8::DOUBLE * ja), 6) AS score FROM j")
def q_map_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_pairs(spark, sf_dir)


@query(f"""WITH {_SETS}, t AS (SELECT count(*) AS n, count(*) FILTER (same) AS exact, count(*) FILTER (NOT same AND greatest(jb, 0.8::DOUBLE * ja) >= 0.2) AS near FROM j)
    SELECT n AS features, exact, near, round(exact / n, 6) AS exact_recall, round((exact + near) / n, 6) AS near_recall FROM t""")
def q_map_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = feature_pairs(spark, sf_dir).agg(F.count("*").alias("features"), F.count_if(F.col("kind") == "exact").alias("exact"), F.count_if((F.col("kind") == "near") & (F.col("score") >= 0.2)).alias("near"))
    return t.withColumns({"exact_recall": exprs.ratio(F.col("exact"), F.col("features")), "near_recall": exprs.ratio(F.col("exact") + F.col("near"), F.col("features"))})


_OUTCOMES = """o AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'fixed' WHEN 'O' THEN 'open' ELSE 'uncertain' END AS a, (['fixed', 'open', 'false-positive', 'uncertain'])[(o_custkey % 4) + 1] AS b FROM orders),
    c AS (SELECT a, b, a = b AS exact, a = b OR (CASE WHEN a IN ('open', 'uncertain') THEN 1 ELSE 0 END) = (CASE WHEN b IN ('open', 'uncertain') THEN 1 ELSE 0 END) AS near FROM o)"""


@query(f"WITH {_OUTCOMES}, g AS (SELECT unnest(['fixed', 'open', 'false-positive', 'uncertain']) AS outcome) SELECT g.outcome, count(c.a) AS rows, count(*) FILTER (exact) AS exact, count(*) FILTER (near) AS near, round(CASE WHEN count(c.a) = 0 THEN 0 ELSE count(*) FILTER (exact) / count(c.a) END, 6) AS exact_accuracy FROM g LEFT JOIN c ON g.outcome = c.a GROUP BY 1")
def q_outcome_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("o_orderstatus") == "F", "fixed").when(F.col("o_orderstatus") == "O", "open").otherwise("uncertain")
    b = F.get(F.array(*[F.lit(x) for x in ("fixed", "open", "false-positive", "uncertain")]), (F.col("o_custkey") % 4).cast("int"))
    c = table(spark, sf_dir, "orders").select(a.alias("outcome"), (a == b).alias("exact"), match.near_outcome(a, b).alias("near"))
    t = c.groupBy("outcome").agg(F.count("*").alias("rows"), F.count_if("exact").alias("exact"), F.count_if("near").alias("near"))
    grid = spark.createDataFrame([(x,) for x in ("fixed", "open", "false-positive", "uncertain")], "outcome string")
    out = grid.join(t, "outcome", "left").select("outcome", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("rows", "exact", "near")])
    return out.withColumn("exact_accuracy", exprs.ratio(F.col("exact"), F.col("rows")))


# review cases: labels are references, a rule over documents makes the predictions
_CASES = """cases AS (
      SELECT l.doc_id AS ordinal, l.quality::BIGINT AS reference_findings, CASE WHEN d.doc_id IS NULL OR d.n_chars % 7 = 0 THEN 0 ELSE (d.n_chars % 3) END::BIGINT AS predicted_findings, coalesce(d.n_chars % 11 <> 0, false) AS parsed, coalesce(d.n_chars % 11 <> 0 AND d.n_chars % 13 <> 0, false) AS schema_valid,
        coalesce(d.n_chars % 11 <> 0 AND d.n_chars % 5 <> 0, false) AS evidence_valid, coalesce(d.n_chars, 0) AS n_chars
      FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l LEFT JOIN documents d ON l.doc_id = d.doc_id),
    full_cases AS (SELECT *, CASE WHEN schema_valid THEN least(reference_findings, predicted_findings) ELSE 0 END AS matched_findings FROM cases)"""


def review_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("reference_findings"))
    n = F.col("n_chars")
    c = labels.join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "left")
    c = c.select(
        F.col("doc_id").alias("ordinal"),
        "reference_findings",
        F.when(n.isNull() | (n % 7 == 0), F.lit(0)).otherwise(n % 3).cast("long").alias("predicted_findings"),
        F.coalesce(n % 11 != 0, F.lit(False)).alias("parsed"),
        F.coalesce((n % 11 != 0) & (n % 13 != 0), F.lit(False)).alias("schema_valid"),
        F.coalesce((n % 11 != 0) & (n % 5 != 0), F.lit(False)).alias("evidence_valid"),
        F.coalesce(n, F.lit(0)).alias("n_chars"),
    )
    matched = F.when(F.col("schema_valid"), F.least("reference_findings", "predicted_findings")).otherwise(0)
    return c.withColumns({"matched_findings": matched, "schema_valid_findings": F.when(F.col("schema_valid"), F.col("predicted_findings")).otherwise(0), "evidence_valid_findings": F.when(F.col("evidence_valid"), F.col("predicted_findings")).otherwise(0), "latency_ms": F.col("n_chars").cast("double"), "cost_usd": F.lit(None).cast("double")})


@query(f"WITH {_CASES} SELECT ordinal, parsed, schema_valid, evidence_valid, reference_findings, predicted_findings, matched_findings FROM full_cases")
def q_review_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_like(spark, sf_dir).select("ordinal", "parsed", "schema_valid", "evidence_valid", "reference_findings", "predicted_findings", F.col("matched_findings").cast("long").alias("matched_findings"))


_METRICS = f"""{_CASES}, t AS (SELECT count(*) AS rows, count(*) FILTER (parsed) AS parsed_rows, count(*) FILTER (schema_valid) AS schema_valid_rows, count(*) FILTER (evidence_valid) AS evidence_valid_rows, count(*) FILTER (reference_findings = 0) AS clean_rows,
      count(*) FILTER (reference_findings = 0 AND predicted_findings = 0) AS clean_correct, sum(reference_findings)::BIGINT AS reference_findings, sum(predicted_findings)::BIGINT AS predicted_findings, sum(matched_findings)::BIGINT AS matched_findings,
      sum(predicted_findings) FILTER (schema_valid)::BIGINT AS schema_valid_findings, sum(predicted_findings) FILTER (evidence_valid)::BIGINT AS evidence_valid_findings FROM full_cases),
    m0 AS (SELECT *, CASE WHEN predicted_findings = 0 THEN 0 ELSE round(matched_findings / predicted_findings, 6) END AS precision, CASE WHEN reference_findings = 0 THEN 0 ELSE round(matched_findings / reference_findings, 6) END AS recall,
      CASE WHEN clean_rows = 0 THEN 0 ELSE round(clean_correct / clean_rows, 6) END AS clean_accuracy, CASE WHEN clean_rows = 0 THEN 0 ELSE round((clean_rows - clean_correct) / clean_rows, 6) END AS clean_fp_rate FROM t),
    m AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE round(2 * precision * recall / (precision + recall), 6) END AS f1 FROM m0)"""
_COUNTERS = ["rows", "parsed_rows", "schema_valid_rows", "evidence_valid_rows", "clean_rows", "clean_correct", "reference_findings", "predicted_findings", "matched_findings", "precision", "recall", "clean_accuracy", "clean_fp_rate", "f1"]


@query(f"WITH {_METRICS} SELECT {', '.join(_COUNTERS)} FROM m")
def q_review_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.review_metrics(review_like(spark, sf_dir)).select(*_COUNTERS)


@query(f"""WITH {_METRICS}, g AS (SELECT f1 >= 0.8 AS a, clean_accuracy >= 0.95 AS b, schema_valid_rows / rows >= 1 AS c, evidence_valid_rows / rows >= 1 AS d, rows, schema_valid_rows, evidence_valid_rows FROM m)
    SELECT a AS "f1_passed", b AS "cleanAccuracy_passed", c AS "schemaValidRate_passed", d AS "evidenceValidRate_passed", a AND b AND c AND d AS passed, round(schema_valid_rows / rows, 6) AS schema_rate FROM g""")
def q_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gate.quality_gate(evaluate.review_metrics(review_like(spark, sf_dir)))
    return g.select("f1_passed", "cleanAccuracy_passed", "schemaValidRate_passed", "evidenceValidRate_passed", "passed", F.round("schema_valid_rate", 6).alias("schema_rate"))


_CODES = """codes AS (SELECT unnest([CASE WHEN NOT parsed THEN 'prediction.output-json-parse' END, CASE WHEN parsed AND NOT schema_valid THEN 'schema.invalid-title' END, CASE WHEN parsed AND NOT evidence_valid THEN 'evidence.path-not-allowed' END, CASE WHEN n_chars % 17 = 0 THEN 'schema.unknown-key' END]) AS code FROM full_cases),
    h AS (SELECT code, count(*) AS issues FROM codes WHERE code IS NOT NULL GROUP BY code)"""


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = review_like(spark, sf_dir)
    rules = [("prediction.output-json-parse", ~F.col("parsed")), ("schema.invalid-title", F.col("parsed") & ~F.col("schema_valid")), ("evidence.path-not-allowed", F.col("parsed") & ~F.col("evidence_valid")), ("schema.unknown-key", F.col("n_chars") % 17 == 0)]
    return c.withColumn("codes", F.array_compact(F.array(*[F.when(bad, code) for code, bad in rules])))


@query(f"WITH {_CASES}, {_CODES} SELECT split_part(code, '.', 1) AS category, sum(issues)::BIGINT AS issues FROM h GROUP BY 1")
def q_issue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.issue_categories(evaluate.issue_histogram(coded(spark, sf_dir)))


@query(f"""WITH {_METRICS}, {_CODES}, i AS (SELECT sum(issues)::BIGINT AS issues, coalesce(sum(issues) FILTER (starts_with(code, 'schema.')), 0)::BIGINT AS schema_issues, coalesce(sum(issues) FILTER (starts_with(code, 'evidence.')), 0)::BIGINT AS evidence_issues FROM h)
    SELECT rows, issues, schema_issues, evidence_issues, round(issues / rows, 6) AS issues_per_row, rows - parsed_rows AS unparseable_rows, rows - schema_valid_rows AS invalid_schema_rows, round((rows - schema_valid_rows) / rows, 6) AS invalid_schema_rate, predicted_findings - schema_valid_findings AS invalid_schema_items, predicted_findings - evidence_valid_findings AS invalid_evidence_items,
      clean_rows - clean_correct AS clean_false_positives, reference_findings - matched_findings AS missed_items, round((reference_findings - matched_findings) / reference_findings, 6) AS missed_rate FROM m, i""")
def q_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = coded(spark, sf_dir)
    return gate.triage(evaluate.review_metrics(cases), evaluate.issue_histogram(cases)).drop("prediction_issues")


@query("SELECT event_type, count(*) FILTER (value >= 30) AS latency_valid, round(coalesce(sum(round(value - 30, 6)::DECIMAL(28, 6)) FILTER (value >= 30), 0), 6)::DOUBLE AS total, round(min(value - 30) FILTER (value >= 30), 6) AS latency_min, round(max(value - 30) FILTER (value >= 30), 6) AS latency_max FROM events GROUP BY 1")
def q_metric_accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") - 30).alias("v"))
    total = F.coalesce(F.sum(F.when(F.col("v") >= 0, F.round("v", 6).cast("decimal(28,6)"))), F.lit(0)).cast("double")
    own = [c for i, c in enumerate(accumulate(F.col("v"), "latency")) if i in (0, 2, 3)]
    return e.groupBy("event_type").agg(*own, total.alias("total"))


_MODELS = """u AS (SELECT user_id, event_type AS model, count(*) AS n, count(*) FILTER (value > 50) AS hits FROM events GROUP BY 1, 2), t AS (SELECT model, sum(n)::BIGINT AS rows, sum(hits)::BIGINT AS matched FROM u GROUP BY 1)"""


@query(
    f"""WITH {_MODELS}, o AS (SELECT a.model AS l, b.model AS r, count(*) FILTER (a.hits > 0 AND b.hits > 0) AS both_matched, count(*) FILTER (a.hits > 0 AND b.hits = 0) AS left_only, count(*) FILTER (a.hits = 0 AND b.hits > 0) AS right_only, count(*) FILTER (a.hits = 0 AND b.hits = 0) AS neither FROM u a JOIN u b ON a.user_id = b.user_id AND a.model < b.model GROUP BY 1, 2)
    SELECT o.l AS "left", o.r AS "right", both_matched, left_only, right_only, neither, round(x.matched / x.rows - y.matched / y.rows, 6) AS delta_recall FROM o JOIN t x ON o.l = x.model JOIN t y ON o.r = y.model"""
)
def q_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("model")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("hits"))
    t = u.groupBy("model").agg((F.sum("hits") / F.sum("n")).alias("recall"))
    deltas = evaluate.pair_deltas(t, ["recall"])
    # a user's models as one sorted array: pairs inside the row
    own = u.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("model", (F.col("hits") > 0).alias("hit")))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["model"] > a["model"]), lambda b: F.struct(a["model"].alias("left"), b["model"].alias("right"), a["hit"].alias("a"), b["hit"].alias("b")))))
    o = exprs.unnest(own, pairs, "x").select("x.*").groupBy("left", "right").agg(F.count_if(F.col("a") & F.col("b")).alias("both_matched"), F.count_if(F.col("a") & ~F.col("b")).alias("left_only"), F.count_if(~F.col("a") & F.col("b")).alias("right_only"), F.count_if(~F.col("a") & ~F.col("b")).alias("neither"))
    return o.join(deltas, ["left", "right"])


@query("""WITH c AS (SELECT conv_id, list({'turn': turn, 't': text} ORDER BY turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, a[-1].t AS t FROM c)
    SELECT count(*) AS rows, count(t) FILTER (t <> '') AS parseable, count(*) FILTER (coalesce(length(t), 0) % 2 = 0) AS clean_rows FROM s""")
def q_reference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn")))
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(last.alias("t"))
    return s.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.col("t") != "", F.lit(False))).alias("parseable"), F.count_if(F.coalesce(F.char_length("t"), F.lit(0)) % 2 == 0).alias("clean_rows"))


# JSON with planted faults


@query(
    """WITH l AS (SELECT l_orderkey + l_linenumber AS k FROM lineitem), c AS (SELECT unnest([CASE WHEN k % 5 = 0 THEN 'schema.invalid-category' END, CASE WHEN k % 7 = 0 THEN 'schema.invalid-title' END, CASE WHEN k % 11 = 0 THEN 'schema.unknown-key' END, CASE WHEN k % 3 = 0 THEN 'schema.invalid-startLine' END, CASE WHEN k % 13 = 0 THEN 'schema.missing-inspected-object' END, CASE WHEN k % 4 = 0 THEN 'schema.invalid-reproduction' END]) AS code FROM l)
    SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY code"""
)
def q_shape_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")

    def pick(n: int, bad: str, good: str) -> Column:
        return F.when(k % n == 0, F.lit(bad)).otherwise(F.lit(good))

    text = F.concat(
        F.lit('{"findings":[{"title":'), pick(7, "5", '"t"'), F.lit(',"category":'), pick(5, '"bugs"', '"bug"'), F.lit(',"severity":"low","confidence":"high",'), pick(11, '"extra":1,', ""), F.lit('"reasoning":"r","recommendation":"r","whyTestsDoNotAlreadyCoverThis":"w","minimumFixScope":"m",'),
        pick(4, "", '"reproduction":null,'), F.lit('"suggestedRegressionTest":null,"evidence":[{"path":"a.py","startLine":'), pick(3, "1.5", "1.0"), F.lit(',"endLine":2,"symbol":null,"quote":null}]}]'), pick(13, "}", ',"inspected":{"files":[],"symbols":["s"],"notes":[]}}'),
    )
    rows = spread(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber")).alias("k"))).select(variants.parse_strict(text).alias("v"))
    issues = exprs.unnest(rows, shapes.review_shape(F.col("v")), "i")
    return issues.groupBy(F.col("i.code").alias("code")).agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT p_partkey AS k FROM part), c AS (SELECT unnest([CASE WHEN k % 5 = 0 THEN 'schema.invalid-kind' END, CASE WHEN k % 3 = 0 THEN 'map.path-not-in-inventory' END, CASE WHEN k % 7 = 0 THEN 'map.path-escapes-root' END, CASE WHEN k % 11 = 0 THEN 'schema.invalid-trustBoundary' END, CASE WHEN k % 13 = 0 THEN 'schema.invalid-created' END, CASE WHEN k % 17 = 0 THEN 'schema.test-ref-not-object' END]) AS code FROM p)
    SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY code"""
)
def q_shape_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")

    def pick(n: int, bad: str, good: str) -> Column:
        return F.when(k % n == 0, F.lit(bad)).otherwise(F.lit(good))

    text = F.concat(
        F.lit('{"features":[{"title":"t","summary":"s","confidence":"low","kind":'), pick(5, '"lib"', '"library"'), F.lit(',"entrypoints":[{"path":'), pick(3, '"b.py"', '"./a.py"'), F.lit(',"symbol":null,"route":null,"command":"x"}],"ownedFiles":[{"path":'), pick(7, '"../a.py"', '"a.py"'),
        F.lit(',"reason":"r"}],"contextFiles":[],"tests":['), pick(17, "1", '{"path":"a.py","command":null}'), F.lit('],"tags":["x"],"trustBoundaries":['), pick(11, '"net"', '"network"'), F.lit(']}],"created":'), pick(13, "-1", "2"), F.lit("}"),
    )
    rows = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))).select(variants.parse_strict(text).alias("v"))
    issues = exprs.unnest(rows, shapes.map_shape(F.col("v"), F.array(F.lit("a.py"))), "i")
    return issues.groupBy(F.col("i.code").alias("code")).agg(F.count("*").alias("n"))


@query(
    """WITH o AS (SELECT o_orderkey AS k FROM orders), c AS (SELECT unnest([CASE WHEN k % 3 = 0 THEN 'schema.invalid-outcome' END, CASE WHEN k % 5 = 0 THEN 'schema.invalid-commands' END, CASE WHEN k % 7 = 0 THEN 'schema.unknown-key' END]) AS code FROM o WHERE k % 19 <> 0 UNION ALL SELECT 'revalidate output is not an object' FROM o WHERE k % 19 = 0)
    SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY code"""
)
def q_shape_revalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"outcome":'), F.when(k % 3 == 0, '"done"').otherwise('"open"'), F.lit(',"reasoning":"r",'), F.when(k % 7 == 0, '"x":0,').otherwise(""), F.lit('"commands":'), F.when(k % 5 == 0, "[1]").otherwise('["ls"]'), F.lit("}"))
    text = F.when(k % 19 == 0, F.lit("[]")).otherwise(body)
    issues = exprs.unnest(spread(table(spark, sf_dir, "orders").select("o_orderkey")).select(variants.parse_strict(text).alias("v")), shapes.revalidate_shape(F.col("v")), "i")
    return issues.groupBy(F.col("i.code").alias("code")).agg(F.count("*").alias("n"))


@query(
    """WITH d AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS n, string_split(text, chr(10))[1] AS head FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'evidence.path-not-allowed' WHEN doc_id % 4 = 1 AND n < 3 THEN 'evidence.range-outside-files-section' WHEN doc_id % 4 = 2 THEN 'evidence.range-inverted' WHEN doc_id % 4 = 3 THEN 'evidence.quote-outside-files-section' ELSE 'ok' END AS code FROM d"""
)
def q_evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("n"), x.alias("text"), x.alias("raw")))
    block = F.struct(F.lit("a.txt").alias("path"), F.lit("d").alias("descriptor"), F.lit("").alias("body"), lines.alias("lines"))
    own = F.when(k == 0, F.lit('{"path":"b.txt","startLine":null,"endLine":null,"quote":"x"}')).when(k == 1, F.lit('{"path":"./a.txt","startLine":1,"endLine":3,"quote":null}')).when(k == 2, F.lit('{"path":"a.txt","startLine":2,"endLine":1,"quote":null}')).otherwise(F.lit('{"path":"a.txt","startLine":1,"endLine":1,"quote":"~~nowhere~~"}'))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.parse_json(own).alias("e"), F.array(block).alias("blocks"))
    found = F.transform(evidence.evidence_issues(F.col("e"), F.array(F.lit("a.txt")), F.col("blocks"), []), lambda x: x["code"])
    return rows.select("doc_id", F.coalesce(F.get(found, F.lit(0)), F.lit("ok")).alias("code"))
