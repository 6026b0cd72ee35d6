"""The evaluation chain over JSON rows: references and predictions made from the tables, with faults planted by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.constants import OUTCOMES
from millrace.functions import exprs, variants
from millrace.operators import evaluate, gate, prompt, smoke
from millrace.plans.registry import query, spread, table


def quoted(s: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(s.alias("x")))
    return F.substring(whole, 6, F.length(whole) - 6)


def join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def by_rest(k: Column, n: int, cases: dict[int, Column | str], other: Column | str) -> Column:
    """A value for each remainder of k."""
    out = F.lit(other) if isinstance(other, str) else other
    for i, value in cases.items():
        out = F.when(k % n == i, value).otherwise(out)
    return out


def reference_rows(keys: DataFrame, prompt_text: Column, output: Column, operation: str) -> DataFrame:
    """ordinal, value: chat rows with a system message, two user messages and two assistant messages, of which one each counts."""
    k = F.col("k")
    ident = by_rest(k, 3, {0: join('"captureId":"c', k.cast("string"), '"'), 1: join('"captureId":"","featureId":"f', k.cast("string"), '"')}, '"captureId":null')
    text = join(
        '{"messages":[{"role":"system","content":"s"},{"role":"user","content":', quoted(prompt_text), '},{"role":"assistant","content":"{}"},{"role":"user","content":"again"},{"role":"assistant","content":', quoted(output),
        '}],"metadata":{', ident, f',"operation":"{operation}"}}}}',
    )
    return keys.select(k.alias("ordinal"), variants.parse_strict(text).alias("value"))


def prediction_rows(keys: DataFrame, output: Column) -> DataFrame:
    """ordinal, value: the output in one of three wrappers, with latency and cost fields of several kinds."""
    k = F.col("k")
    more = join(
        by_rest(k, 5, {0: join('"latencyMs":', (k % 100).cast("string"), ","), 1: '"metrics":{"usage":{"duration_ms":7}},', 2: '"usage":{"latency_ms":"fast"},'}, ""),
        by_rest(k, 7, {0: '"cost":-1,', 1: '"metadata":{"cost_usd":0.5},'}, ""),
    )
    wrapped = by_rest(F.floor(k / 8), 3, {0: join('"messages":[{"role":"assistant","content":', quoted(output), "}]"), 1: join('"choices":[{"message":{"content":', quoted(output), "}}]")}, join('"output":', quoted(output)))
    return keys.select(k.alias("ordinal"), variants.parse_strict(join("{", more, wrapped, "}")).alias("value"))


# reviews: findings of customers. What a prediction is follows from (key + shift) % 8.

_CONTEXT = '{"includedFiles":[{"path":"./src/a.py"},{"path":"src/b.py","readable":false}]}'


def _block(path: str) -> str:
    return f"--- {path} (excerpt)\n" + "".join(f"{i} | line {i} of {path}\n" for i in range(1, 13))


def _finding(title: str, category: str, severity: str, path: str, first: int, last: int) -> str:
    return (
        f'{{"title":"{title}","category":"{category}","severity":"{severity}","confidence":"high","evidence":[{{"path":"{path}","startLine":{first},"endLine":{last},"symbol":null,"quote":null}}],'
        '"reasoning":"r","reproduction":null,"recommendation":"r","whyTestsDoNotAlreadyCoverThis":"w","suggestedRegressionTest":null,"minimumFixScope":"m"}'
    )


def _review(*findings: str) -> str:
    return '{"findings":[' + ",".join(findings) + '],"inspected":{"files":[],"symbols":[],"notes":[]}}'


_FIRST, _SECOND = ("null pointer in parser", "bug", "high", "src/a.py"), ("race in writer thread", "concurrency", "low", "./src/b.py")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


def review_output(shift: int) -> Column:
    """Zero to two findings, moved by some lines."""
    a, b = _finding(*_FIRST, 2 + shift, 4 + shift), _finding(*_SECOND, 5 + shift, 6 + shift)
    n = F.when(F.col("k") % 11 == 0, 0).otherwise(F.col("k") % 3)
    return F.when(n == 0, _review()).when(n == 1, _review(a)).otherwise(_review(a, b))


def review_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    context = F.when(k % 2 == 0, f"\nPrompt context:\n{_CONTEXT}\n\nJSON shape: {{}}").otherwise("")
    text = join("Review this.", context, "\nFiles:\n", _block("src/a.py"), _block("src/b.py"))
    output = F.when(k % 11 == 0, "no JSON at all").otherwise(review_output(0))
    return evaluate.references(reference_rows(customers(spark, sf_dir), text, output, "review"))


def review_predictions(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    kinds = {
        0: review_output(0),
        2: F.lit("not json"),
        3: F.lit(_review(_finding("null pointer in parser", "bugs", "high", "src/a.py", 2, 4))),
        4: F.lit(_review(_finding("null pointer in parser", "bug", "high", "src/zzz.py", 2, 4))),
        5: review_output(5),
        6: F.lit(_review(_finding("completely different words", "docs-gap", "medium", "src/a.py", 2, 4))),
    }
    keys = customers(spark, sf_dir).where((F.col("k") + shift) % 8 != 1)
    return prediction_rows(keys, by_rest(F.col("k") + shift, 8, kinds, _review()))


def reviewed(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    return evaluate.review_cases(evaluate.by_ordinal(review_references(spark, sf_dir), review_predictions(spark, sf_dir, shift)))


def _review_sql(shift: int = 0, name: str = "r") -> str:
    return f"""{name}_b AS (SELECT c_custkey AS k, (c_custkey + {shift}) % 8 AS p, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE c_custkey % 3 END AS n FROM customer),
    {name}_c AS (SELECT *, (k % 2 = 0 AND n = 2)::BIGINT AS bad FROM {name}_b),
    {name} AS (SELECT k AS ordinal, p, bad, CASE WHEN k % 3 = 0 THEN 'c' || k WHEN k % 3 = 1 THEN 'f' || k ELSE 'row-' || k END AS id, p NOT IN (1, 2) AS parsed, p NOT IN (1, 2, 3) AS schema_valid,
      p NOT IN (1, 2, 4) AND NOT (p IN (0, 5) AND bad = 1) AS evidence_valid, n AS reference_findings, CASE WHEN p IN (0, 5) THEN n WHEN p IN (3, 4, 6) THEN 1 ELSE 0 END AS predicted_findings,
      CASE WHEN p IN (0, 5) THEN n WHEN p IN (4, 6) THEN 1 ELSE 0 END AS schema_valid_findings, CASE WHEN p IN (0, 5) THEN n - bad WHEN p IN (3, 6) THEN 1 ELSE 0 END AS evidence_valid_findings,
      CASE WHEN p IN (0, 5) THEN n - bad WHEN p = 6 AND n > 0 THEN 1 ELSE 0 END AS matched_findings, CASE p WHEN 0 THEN 1.0 WHEN 5 THEN 0.85 WHEN 6 THEN 0.7 ELSE 0 END AS each,
      {_MEASURED} FROM {name}_c)"""


_MEASURED = """p <> 1 AND k % 5 IN (0, 1, 2) AS latency_present, CASE WHEN p = 1 THEN NULL WHEN k % 5 = 0 THEN (k % 100)::DOUBLE WHEN k % 5 = 1 THEN 7.0::DOUBLE END AS latency_ms,
      p <> 1 AND k % 7 IN (0, 1) AS cost_present, CASE WHEN p <> 1 AND k % 7 = 1 THEN 0.5::DOUBLE END AS cost_usd"""
_MEASURE_CODES = "CASE WHEN latency_present AND latency_ms IS NULL THEN 'latency.invalid' END, CASE WHEN cost_present AND cost_usd IS NULL THEN 'cost.invalid' END"
_REVIEW_CODES = f"""list_filter(CASE WHEN p = 1 THEN ['prediction.missing-row', 'prediction.output-json-parse'] WHEN p = 2 THEN ['unparseable-prediction', 'evidence.unparseable-prediction', 'prediction.output-json-parse']
    WHEN p = 3 THEN ['schema.invalid-category'] WHEN p = 4 THEN ['evidence.path-not-allowed', 'evidence.path-not-in-files-section'] WHEN p IN (0, 5) AND bad = 1 THEN ['evidence.path-not-allowed'] ELSE [] END || [{_MEASURE_CODES}], lambda x: x IS NOT NULL)"""
_COLUMNS = "ordinal, id, parsed, schema_valid, evidence_valid, reference_findings, predicted_findings, schema_valid_findings, evidence_valid_findings, matched_findings, latency_present, latency_ms, cost_present, cost_usd"


@query(f"WITH {_review_sql()} SELECT {_COLUMNS}, round(matched_findings * each, 6)::DOUBLE AS score, array_to_string(list_sort({_REVIEW_CODES}), ',') AS codes FROM r")
def q_eval_review_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.aggregate("matches", F.lit(0.0), lambda a, m: a + m["score"], lambda a: F.round(a, 6))
    longs = [F.col(c).cast("long").alias(c) if c.endswith("findings") else F.col(c) for c in _COLUMNS.split(", ")]
    return reviewed(spark, sf_dir).select(*longs, score.alias("score"), F.array_join(F.array_sort("codes"), ",").alias("codes"))


_TOTALS = """count(*) AS rows, count(*) FILTER (parsed) AS parsed_rows, count(*) FILTER (schema_valid) AS schema_valid_rows, count(*) FILTER (evidence_valid) AS evidence_valid_rows, count(*) FILTER (reference_findings = 0) AS clean_rows,
      count(*) FILTER (reference_findings = 0 AND predicted_findings = 0) AS clean_correct, count(*) FILTER (reference_findings = 0 AND predicted_findings > 0) AS clean_false_positives, count(*) FILTER (reference_findings > 0) AS nonclean_rows,
      count(*) FILTER (reference_findings > 0 AND predicted_findings > 0) AS nonclean_any, sum(reference_findings)::BIGINT AS reference_findings, sum(predicted_findings)::BIGINT AS predicted_findings, sum(matched_findings)::BIGINT AS matched_findings,
      sum(schema_valid_findings)::BIGINT AS schema_valid_findings, sum(evidence_valid_findings)::BIGINT AS evidence_valid_findings"""
_MEASURE_TOTALS = ", ".join(
    f"count(*) FILTER ({n}_present) AS {n}_present, count({c}) AS {n}_valid, count(*) FILTER ({n}_present AND {c} IS NULL) AS {n}_invalid, round(coalesce(sum({c}), 0), 6) AS {n}_sum, round(min({c}), 6) AS {n}_min, round(max({c}), 6) AS {n}_max, round(avg({c}), 6) AS {n}_avg"
    for n, c in (("latency", "latency_ms"), ("cost", "cost_usd"))
)


def _rates(source: str) -> str:
    return f"""{source}_rates AS (SELECT *, CASE WHEN predicted_findings = 0 THEN 0 ELSE round(matched_findings / predicted_findings, 6) END AS precision, CASE WHEN reference_findings = 0 THEN 0 ELSE round(matched_findings / reference_findings, 6) END AS recall,
      CASE WHEN clean_rows = 0 THEN 0 ELSE round(clean_correct / clean_rows, 6) END AS clean_accuracy, CASE WHEN clean_rows = 0 THEN 0 ELSE round((clean_rows - clean_correct) / clean_rows, 6) END AS clean_fp_rate FROM {source}_t),
    {source}_m AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE round(2 * precision * recall / (precision + recall), 6) END AS f1 FROM {source}_rates)"""


@query(f"WITH {_review_sql()}, r_t AS (SELECT {_TOTALS}, {_MEASURE_TOTALS} FROM r), {_rates('r')} SELECT * FROM r_m")
def q_eval_review_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.review_metrics(reviewed(spark, sf_dir))


@query(f"WITH {_review_sql()}, codes AS (SELECT unnest({_REVIEW_CODES}) AS code FROM r) SELECT code, count(*) AS issues FROM codes GROUP BY code")
def q_eval_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.issue_histogram(reviewed(spark, sf_dir))


_HITS = "CASE WHEN p IN (0, 5) THEN (CASE WHEN reference_findings = 0 THEN [] WHEN matched_findings = 2 THEN [0, 1] ELSE [0] END) WHEN p = 6 AND reference_findings > 0 THEN [0] ELSE [] END"


@query(
    f"""WITH {_review_sql(0, "x")}, {_review_sql(3, "y")}, x_h AS (SELECT *, {_HITS} AS hits FROM x), y_h AS (SELECT *, {_HITS} AS hits FROM y),
    x_t AS (SELECT {_TOTALS}, {_MEASURE_TOTALS} FROM x), y_t AS (SELECT {_TOTALS}, {_MEASURE_TOTALS} FROM y), {_rates("x")}, {_rates("y")},
    o AS (SELECT sum(len(list_intersect(a.hits, b.hits)))::BIGINT AS both_matched, sum(len(a.hits) - len(list_intersect(a.hits, b.hits)))::BIGINT AS left_only, sum(len(b.hits) - len(list_intersect(a.hits, b.hits)))::BIGINT AS right_only,
        sum(a.reference_findings - len(list_distinct(a.hits || b.hits)))::BIGINT AS neither_matched,
        count(*) FILTER (a.reference_findings = 0 AND a.predicted_findings = 0 AND b.predicted_findings = 0) AS both_clean, count(*) FILTER (a.reference_findings = 0 AND a.predicted_findings = 0 AND b.predicted_findings > 0) AS left_clean,
        count(*) FILTER (a.reference_findings = 0 AND a.predicted_findings > 0 AND b.predicted_findings = 0) AS right_clean, count(*) FILTER (a.reference_findings = 0 AND a.predicted_findings > 0 AND b.predicted_findings > 0) AS neither_clean
      FROM x_h a JOIN y_h b ON a.ordinal = b.ordinal)
    SELECT 'one' AS "left", 'two' AS "right", o.*, round(x_m.precision - y_m.precision, 6) AS delta_precision, round(x_m.recall - y_m.recall, 6) AS delta_recall, round(x_m.f1 - y_m.f1, 6) AS delta_f1, round(x_m.clean_accuracy - y_m.clean_accuracy, 6) AS delta_clean_accuracy,
      round(x_m.latency_avg - y_m.latency_avg, 6) AS delta_latency_avg, round(x_m.cost_sum - y_m.cost_sum, 6) AS delta_cost_sum FROM o, x_m, y_m"""
)
def q_eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = [reviewed(spark, sf_dir, shift).withColumn("model", F.lit(name)) for name, shift in (("one", 0), ("two", 3))]
    cases = models[0].union(models[1])
    deltas = evaluate.pair_deltas(evaluate.review_metrics(cases, ["model"]), ["precision", "recall", "f1", "clean_accuracy", "latency_avg", "cost_sum"])
    return evaluate.pair_overlap(cases).join(deltas, ["left", "right"])


@query("SELECT count(*) AS rows, count(*) FILTER (c_custkey % 11 <> 0) AS parseable, count(*) FILTER (c_custkey % 11 <> 0) AS schema_valid, count(*) FILTER (c_custkey % 11 = 0 OR c_custkey % 3 = 0) AS clean_rows, count(*) FILTER (c_custkey % 11 <> 0 AND c_custkey % 3 > 0) AS finding_rows, sum(CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE c_custkey % 3 END)::BIGINT AS findings FROM customer")
def q_eval_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.reference_summary(review_references(spark, sf_dir))


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 8 <> 1) + 3 AS p FROM customer)
    SELECT n AS reference_rows, p AS prediction_rows, 1::BIGINT AS json_line_errors, greatest(0, p - n) AS extra_rows, greatest(0, n - p) AS missing_rows FROM c""")
def q_eval_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = review_predictions(spark, sf_dir).select("value", F.lit(False).alias("error"))
    extra = spark.createDataFrame([("{}",), ("[]",), ("oops",)], "s string").select(variants.parse_strict(F.col("s")).alias("value")).select("value", F.col("value").isNull().alias("error"))
    return evaluate.row_counts(customers(spark, sf_dir), own.union(extra))


@query(f"""WITH {_review_sql()}, r_t AS (SELECT {_TOTALS} FROM r), {_rates('r')}, codes AS (SELECT unnest({_REVIEW_CODES}) AS code FROM r), i AS (SELECT count(*) AS issues, count(*) FILTER (starts_with(code, 'prediction.')) AS prediction_issues FROM codes)
    SELECT f1 >= 0.3 AS f1_passed, clean_accuracy >= 0.5 AS accuracy_passed, schema_valid_rows / rows >= 0.9 AS schema_passed, round(parsed_rows / rows, 6) AS parsed_rate, (f1 >= 0.3 AND clean_accuracy >= 0.5 AND schema_valid_rows / rows >= 0.9 AND evidence_valid_rows / rows >= 0.2)::INT AS exit_zero, issues, prediction_issues FROM r_m, i""")
def q_eval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score report written as JSON, read by the gate, with thresholds of its own."""
    cases = reviewed(spark, sf_dir)
    report = evaluate.score_report("review", evaluate.reference_summary(review_references(spark, sf_dir)), evaluate.review_metrics(cases).withColumn("label", F.lit("m")))
    read = gate.score_report(report.select(variants.parse_strict(F.col("report")).alias("value")))
    limits = gate.check_thresholds({"f1": 0.3, "cleanAccuracy": 0.5, "schemaValidRate": 0.9, "evidenceValidRate": 0.2})
    gated = gate.quality_gate(read, limits)
    passed = gate.all_passed(gated)
    issues = gate.triage(evaluate.review_metrics(cases), evaluate.issue_histogram(cases)).select("issues", "prediction_issues")
    own = gated.select("f1_passed", F.col("cleanAccuracy_passed").alias("accuracy_passed"), F.col("schemaValidRate_passed").alias("schema_passed"), F.round("parsed_rate", 6).alias("parsed_rate"))
    return own.crossJoin(passed.select(F.col("passed").cast("int").alias("exit_zero"))).crossJoin(issues)  # one row each


# maps: features of suppliers


def map_prompt() -> Column:
    """Paths at depths 1 to 9, of which those to 8 count, and strings that aren't paths."""
    files = ",".join(f'"src/m{i}.py","./src/x{i}.py"' for i in range(2))
    nested = '{"f":"src/deep9.py"}'
    for _ in range(7):
        nested = f'{{"a":{nested}}}'
    # {"tree": seven objects: the string is below depth 8}; one level less for the other
    other = '{"f":"src/deep8.py"}'
    for _ in range(6):
        other = f'{{"a":{other}}}'
    return F.lit(f'Map.\nRepository inventory:\n{{"files":[{files}],"note":"just words","up":"../out.py","t":{nested},"u":{other}}}\n\nJSON shape: {{}}')


def _feature(ident: str, files: list[str], entry: str | None = None) -> str:
    owned = ",".join(f'{{"path":"{f}","reason":"r"}}' for f in files)
    entries = f'[{{"path":"{entry}","symbol":null,"route":null,"command":null}}]' if entry else "[]"
    return f'{{"featureId":"{ident}","title":"t","summary":"s","confidence":"low","kind":"library","entrypoints":{entries},"ownedFiles":[{owned}],"contextFiles":[],"tests":[],"tags":[],"trustBoundaries":[]}}'


def _map(*features: str) -> str:
    return '{"features":[' + ",".join(features) + '],"created":1,"changed":0,"stale":0}'


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")))


def _features(make) -> Column:
    """An output of zero to two features, made by number."""
    n = F.col("k") % 3
    return F.when(n == 0, _map()).when(n == 1, _map(make(0))).otherwise(_map(make(0), make(1)))


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = evaluate.references(reference_rows(suppliers(spark, sf_dir), map_prompt(), _features(lambda i: _feature(f"f{i}", [f"src/m{i}.py"])), "map"))
    kinds = {
        0: _features(lambda i: _feature(f"f{1 - i}", [f"src/m{1 - i}.py"])),
        2: _features(lambda i: _feature(f"g{i}", [f"./src/m{i}.py", f"src/m{i}.py"])),
        3: _features(lambda i: _feature("", [f"src/m{i}.py", f"src/x{i}.py"], "src/deep8.py")),
        4: F.lit(_map(_feature("f0", ["src/deep9.py"]))),
        5: F.lit("not json"),
    }
    keys = suppliers(spark, sf_dir).where("k % 6 <> 1")
    return evaluate.map_cases(evaluate.by_ordinal(refs, prediction_rows(keys, by_rest(F.col("k"), 6, kinds, _map()))))


_MAP = f"""b AS (SELECT s_suppkey AS k, s_suppkey % 6 AS p, s_suppkey % 3 AS n FROM supplier),
    m AS (SELECT k AS ordinal, p, CASE WHEN k % 3 = 0 THEN 'c' || k WHEN k % 3 = 1 THEN 'f' || k ELSE 'row-' || k END AS id, p NOT IN (1, 5) AS parsed, p NOT IN (1, 4, 5) AS schema_valid, n AS reference_features, CASE WHEN p IN (0, 2, 3) THEN n WHEN p = 4 THEN 1 ELSE 0 END AS predicted_features,
      CASE WHEN p IN (0, 2, 3) THEN n ELSE 0 END AS schema_valid_features, CASE WHEN p = 2 THEN n WHEN p = 0 AND n = 2 THEN 2 ELSE 0 END AS exact, CASE WHEN p = 3 THEN n ELSE 0 END AS near, {_MEASURED} FROM b)"""
_MAP_CODES = f"list_filter(CASE WHEN p = 1 THEN ['prediction.missing-row', 'prediction.output-json-parse'] WHEN p = 5 THEN ['unparseable-prediction', 'prediction.output-json-parse'] WHEN p = 4 THEN ['map.path-not-in-inventory'] ELSE [] END || [{_MEASURE_CODES}], lambda x: x IS NOT NULL)"
_MAP_COLUMNS = "ordinal, id, parsed, schema_valid, reference_features, predicted_features, schema_valid_features, exact, near"


@query(f"WITH {_MAP} SELECT {_MAP_COLUMNS}, array_to_string(list_sort({_MAP_CODES}), ',') AS codes FROM m")
def q_eval_map_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    longs = [F.col(c).cast("long").alias(c) if c.endswith("features") or c in ("exact", "near") else F.col(c) for c in _MAP_COLUMNS.split(", ")]
    return mapped(spark, sf_dir).select(*longs, F.array_join(F.array_sort("codes"), ",").alias("codes"))


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE round(({a}) / {b}, 6) END"


@query(
    f"""WITH {_MAP}, t AS (SELECT count(*) AS rows, count(*) FILTER (parsed) AS parsed_rows, count(*) FILTER (schema_valid) AS schema_valid_rows, sum(reference_features)::BIGINT AS reference_features, sum(predicted_features)::BIGINT AS predicted_features, sum(schema_valid_features)::BIGINT AS schema_valid_features, sum(exact)::BIGINT AS exact, sum(near)::BIGINT AS near, {_MEASURE_TOTALS} FROM m),
    q AS (SELECT *, {_ratio("exact", "predicted_features")} AS exact_precision, {_ratio("exact", "reference_features")} AS exact_recall, {_ratio("exact + near", "predicted_features")} AS near_precision, {_ratio("exact + near", "reference_features")} AS near_recall FROM t)
    SELECT *, CASE WHEN exact_precision + exact_recall = 0 THEN 0 ELSE round(2 * exact_precision * exact_recall / (exact_precision + exact_recall), 6) END AS exact_f1, CASE WHEN near_precision + near_recall = 0 THEN 0 ELSE round(2 * near_precision * near_recall / (near_precision + near_recall), 6) END AS near_f1 FROM q"""
)
def q_eval_map_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.map_metrics(mapped(spark, sf_dir))


# revalidations: outcomes of parts


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")))


def _outcome(value: Column) -> Column:
    return join('{"outcome":"', value, '","reasoning":"r","commands":["ls"]}')


def _named(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, OUTCOMES)), number.cast("int"))


def revalidate_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    evidence = join('[{"path":"./src/p', (k % 5).cast("string"), '.py"},{"path":7},{"path":"src/p', (k % 5).cast("string"), '.py"},{"path":"b.py"}]')
    text = join('Check again.\nFinding:\n{"evidence":', evidence, "}")
    return evaluate.references(reference_rows(parts(spark, sf_dir), text, _outcome(_named(k % 4)), "revalidate"))


def revalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    twin = _named(F.element_at(F.array(*map(F.lit, (2, 3, 0, 1))), (k % 4 + 1).cast("int")))
    kinds = {0: _outcome(_named(k % 4)), 2: _outcome(_named((k + 1) % 4)), 3: _outcome(twin), 4: _outcome(F.lit("done")), 5: F.lit("not json")}
    found = prediction_rows(parts(spark, sf_dir).where("k % 7 not in (1, 6)"), by_rest(k, 7, kinds, "{}"))
    lists = parts(spark, sf_dir).where("k % 7 = 6").select(k.alias("ordinal"), F.parse_json(F.lit("[1]")).alias("value"))
    return evaluate.revalidate_cases(evaluate.by_ordinal(revalidate_references(spark, sf_dir), found.union(lists)))


_REVALIDATE = f"""b AS (SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 6 THEN 1 ELSE p_partkey % 7 END AS p, p_partkey % 7 = 6 AS listed, p_partkey % 4 AS o FROM part),
    c AS (SELECT k, p, listed, o, CASE p WHEN 0 THEN o WHEN 2 THEN (o + 1) % 4 WHEN 3 THEN (o + 2) % 4 END AS x, {_MEASURED} FROM b),
    v AS (SELECT k AS ordinal, p, listed, CASE WHEN k % 3 = 0 THEN 'c' || k WHEN k % 3 = 1 THEN 'f' || k ELSE 'row-' || k END AS id, p NOT IN (1, 5) AS parsed, p NOT IN (1, 4, 5) AS schema_valid, (['fixed', 'open', 'false-positive', 'uncertain'])[o + 1] AS reference_outcome,
      CASE WHEN p = 4 THEN 'done' ELSE (['fixed', 'open', 'false-positive', 'uncertain'])[x + 1] END AS predicted_outcome, coalesce(o = x, false) AS exact, coalesce(o % 2 = x % 2, false) AS near, latency_present, latency_ms, cost_present, cost_usd FROM c)"""
_REVALIDATE_CODES = f"list_filter(CASE WHEN listed THEN ['prediction.invalid-jsonl-row', 'prediction.output-json-parse'] WHEN p = 1 THEN ['prediction.missing-row', 'prediction.output-json-parse'] WHEN p = 5 THEN ['unparseable-prediction', 'prediction.output-json-parse'] WHEN p = 4 THEN ['schema.invalid-outcome'] ELSE [] END || [{_MEASURE_CODES}], lambda x: x IS NOT NULL)"


@query(f"WITH {_REVALIDATE} SELECT ordinal, id, parsed, schema_valid, reference_outcome, predicted_outcome, exact, near, array_to_string(list_sort({_REVALIDATE_CODES}), ',') AS codes FROM v")
def q_eval_revalidate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revalidated(spark, sf_dir).select("ordinal", "id", "parsed", "schema_valid", "reference_outcome", "predicted_outcome", "exact", "near", F.array_join(F.array_sort("codes"), ",").alias("codes"))


@query(
    f"""WITH {_REVALIDATE}, t AS (SELECT count(*) AS rows, count(*) FILTER (parsed) AS parsed_rows, count(*) FILTER (schema_valid) AS schema_valid_rows, count(*) FILTER (exact) AS exact, count(*) FILTER (near) AS near, {_MEASURE_TOTALS} FROM v)
    SELECT *, {_ratio("exact", "rows")} AS exact_accuracy, {_ratio("near", "rows")} AS near_accuracy FROM t"""
)
def q_eval_revalidate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.revalidate_metrics(revalidated(spark, sf_dir))


@query(f"WITH {_REVALIDATE}, g AS (SELECT unnest(['fixed', 'open', 'false-positive', 'uncertain', 'done']) AS outcome) SELECT outcome, (SELECT count(*) FROM v WHERE predicted_outcome = outcome) AS rows FROM g")
def q_eval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.outcome_counts(revalidated(spark, sf_dir), "predicted_outcome")


@query("SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 3 = 0 THEN 'c' || p_partkey WHEN p_partkey % 3 = 1 THEN 'f' || p_partkey ELSE 'row-' || p_partkey END AS id, 'revalidate' AS operation, 'b.py,src/p' || (p_partkey % 5) || '.py' AS allowed FROM part")
def q_eval_revalidate_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = revalidate_references(spark, sf_dir)
    return refs.select("ordinal", "id", "operation", F.array_join(prompt.finding_paths(F.col("prompt")), ",").alias("allowed"))


@query("SELECT s_suppkey AS ordinal, 5::BIGINT AS n_paths, 'src/deep8.py,src/m0.py,src/m1.py,src/x0.py,src/x1.py' AS paths FROM supplier")
def q_eval_map_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suppliers(spark, sf_dir).select(F.col("k").alias("ordinal"), prompt.paths_in(prompt.walk_strings(prompt.inventory(join(map_prompt(), F.lit(""))))).alias("p"))
    return rows.select("ordinal", F.size("p").cast("long").alias("n_paths"), F.array_join("p", ",").alias("paths"))


@query("SELECT DISTINCT 'review' AS operation FROM customer")
def q_eval_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one operation of the references, as it is found when none is named."""
    return spark.createDataFrame([(smoke.one_operation(review_references(spark, sf_dir)),)], "operation string")
