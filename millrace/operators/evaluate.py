"""Predictions against references: extraction, per-row cases, metrics, model pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.constants import COST_KEYS, LATENCY_KEYS, METRIC_CONTAINERS, OUTCOMES, WRAPPER_KEYS
from millrace.functions import exprs, variants
from millrace.functions.variants import field, items, kind, text
from millrace.operators import evidence, gate, match, prompt, shapes

# extraction


def role_contents(row: Column, role: str) -> Column:
    own = F.filter(items(field(row, "messages")), lambda m: text(field(m, "role")) == role)
    return F.transform(own, lambda m: field(m, "content"))


def operation_of(row: Column) -> Column:
    return F.coalesce(F.when(text(field(row, "operation")) != "", text(field(row, "operation"))), text(field(field(row, "metadata"), "operation")), F.lit(""))


def reference_id(row: Column, ordinal: Column) -> Column:
    meta = field(row, "metadata")
    return exprs.first_id(*[text(field(meta, n)) for n in ("captureId", "featureId", "captureRunId")], ordinal=ordinal)


def references(rows: DataFrame) -> DataFrame:
    """ordinal, id, operation, prompt (first user message), output (last assistant message, parsed) of rows: ordinal, value."""
    row = F.col("value")
    return rows.select("ordinal", reference_id(row, F.col("ordinal")).alias("id"), operation_of(row).alias("operation"), text(F.get(role_contents(row, "user"), F.lit(0))).alias("prompt"), variants.parse_strict(text(F.element_at(F.when(F.size(role_contents(row, "assistant")) > 0, role_contents(row, "assistant")), -1))).alias("output"))


def unwrap(row: Column) -> Column:
    """The output in a prediction row: chat messages, choices, a named wrapper, or the row itself. Strings are parsed, objects taken."""

    def taken(v: Column) -> Column:
        return exprs.let(v, lambda x: F.when(kind(x) == "string", variants.parse_strict(text(x))).when(kind(x).isin("object", "array"), x))

    choice = F.get(items(field(row, "choices")), F.lit(0))
    last = F.get(F.slice(role_contents(row, "assistant"), -1, 1), F.lit(0))
    sources = [(kind(field(row, "messages")) == "array", taken(last)), (kind(field(row, "choices")) == "array", taken(F.coalesce(field(field(choice, "message"), "content"), field(choice, "text"))))]
    sources += [(kind(field(row, k)).isin("string", "object"), taken(field(row, k))) for k in WRAPPER_KEYS]
    out = row
    for holds, value in reversed(sources):
        out = F.when(holds, value).otherwise(out)
    return F.when(kind(row) == "object", out)


def metric_places(row: Column, depth: int = 3) -> Column:
    """The row and the metric containers in it, to a depth: what is in one before what is beside it."""
    own = ", ".join(f"try_variant_get({{v}}, '$.{c}', 'variant')" for c in METRIC_CONTAINERS)
    text = "array({v})"
    for level in range(depth):
        inner = text.format(v=f"x{level}")
        text = f"concat(array({{v}}), flatten(transform(array_compact(array({own})), x{level} -> {inner})))"
    return variants.let_sql(row, "row", text.format(v="row"))


def metric(places: Column, names: list[str]) -> Column:
    """The first of the fields in the first of the places that has one (a null counts)."""
    fields = ", ".join(f"try_variant_get(p, '$.{n}', 'variant')" for n in names)
    return variants.let_sql(places, "ps", f"get(array_compact(transform(ps, p -> coalesce({fields}))), 0)")


def accumulate(v: Column, name: str, present: Column | None = None) -> list[Column]:
    """valid (a finite number from 0), sum, min, max and avg, present and invalid of a metric field. present: whether it is there at all."""
    valid = v.isNotNull() & (v >= 0) & (v < F.lit(float("inf")))
    there = v.isNotNull() if present is None else present
    own = F.when(valid, v)
    others = [F.count_if(there).alias(f"{name}_present"), F.count_if(there & ~F.coalesce(valid, F.lit(False))).alias(f"{name}_invalid")]
    return [F.count_if(valid).alias(f"{name}_valid"), F.round(F.coalesce(F.sum(own), F.lit(0.0)), 6).alias(f"{name}_sum"), F.round(F.min(own), 6).alias(f"{name}_min"), F.round(F.max(own), 6).alias(f"{name}_max"), F.round(F.avg(own), 6).alias(f"{name}_avg"), *others]


def by_ordinal(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """References with the prediction of the same ordinal (null: missing)."""
    return reference.join(predicted.select("ordinal", F.col("value").alias("prediction")), "ordinal", "left")


def row_counts(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: reference_rows, prediction_rows, extra_rows, missing_rows, json_line_errors. predicted: value, error."""
    r = reference.agg(F.count("*").alias("reference_rows"))
    p = predicted.agg(F.count("*").alias("prediction_rows"), F.count_if("error").alias("json_line_errors"))
    both = r.crossJoin(F.broadcast(p))  # one row each
    gap = lambda a, b: exprs.bounded_gap(F.col(a), F.col(b))
    return both.select("*", gap("prediction_rows", "reference_rows").alias("extra_rows"), gap("reference_rows", "prediction_rows").alias("missing_rows"))


# cases


def prompt_info(cases: DataFrame) -> DataFrame:
    p = F.col("prompt")
    blocks = prompt.file_blocks(prompt.section(p, "\nFiles:\n"))
    context = prompt.prompt_context(p)
    # files count as readable unless they say that they aren't
    unreadable = lambda f: (kind(field(f, "readable")) == "boolean") & ~F.try_variant_get(f, "$.readable", "boolean")
    readable = F.filter(items(field(context, "includedFiles")), lambda f: ~F.coalesce(unreadable(f), F.lit(False)))
    included = F.filter(F.transform(readable, lambda f: text(field(f, "path"))), lambda x: x.isNotNull())
    with_blocks = cases.withColumn("blocks", blocks).withColumn("listed", prompt.listed(p)).withColumn("included", included)
    return with_blocks.withColumn("allowed", prompt.allowed_paths(F.col("listed"), F.col("included"), F.col("blocks"))).drop("listed", "included")


def _prediction_issues(parsed: Column, more: list[str]) -> Column:
    """Codes of a prediction row that has no output: why, and that its output can't be parsed. None for one that has."""
    k = kind(F.col("prediction"))
    why = F.when(F.coalesce(k.isin("missing", "null"), F.lit(True)), F.array(F.lit("prediction.missing-row"))).when(k != "object", F.array(F.lit("prediction.invalid-jsonl-row"))).otherwise(F.array(F.lit("unparseable-prediction"), *map(F.lit, more)))
    return F.when(parsed, F.array().cast("array<string>")).otherwise(F.concat(why, F.array(F.lit("prediction.output-json-parse"))))


def _measured(c: DataFrame) -> DataFrame:
    """Adds latency and cost: whether they are there, and their numbers; and codes for those that are no number from 0."""
    c = c.withColumn("_places", metric_places(F.col("prediction")))
    c = c.withColumns({"_latency": metric(F.col("_places"), LATENCY_KEYS), "_cost": metric(F.col("_places"), COST_KEYS)})
    out = {}
    for name, unit in (("latency", "ms"), ("cost", "usd")):
        n = variants.number(F.col(f"_{name}"))
        there = F.col(f"_{name}").isNotNull() & (kind(F.col("prediction")) == "object")
        out |= {f"{name}_present": there, f"{name}_{unit}": F.when(there & (n >= 0), n)}
    c = c.withColumns(out)
    wrong = [F.when(F.col(f"{n}_present") & F.col(f"{n}_{u}").isNull(), F.lit(f"{n}.invalid")) for n, u in (("latency", "ms"), ("cost", "usd"))]
    return c.withColumn("codes", F.concat("codes", F.array_compact(F.array(*wrong)))).drop("_places", "_latency", "_cost")


def review_cases(cases: DataFrame) -> DataFrame:
    """One row a reference row with everything that metrics count. cases: ordinal, id, prompt, output, prediction.

    A missing or unreadable prediction counts as no findings, so as right on a clean row.
    """
    c = prompt_info(cases).withColumn("predicted", unwrap(F.col("prediction")))
    parsed = F.col("predicted").isNotNull()
    c = c.withColumns({"shape": F.when(parsed, shapes.review_shape(F.col("predicted"))).otherwise(variants.no_issues()), "cited": F.when(parsed, evidence.review_evidence(F.col("predicted"), F.col("allowed"), F.col("blocks"))).otherwise(variants.no_issues())})
    c = c.withColumns({"own": items(field(F.col("output"), "findings")), "found": items(field(F.col("predicted"), "findings"))})
    n = F.size("found")
    c = c.withColumns({"valid": evidence.valid_items(n, F.col("cited"), "findings"), "shaped": evidence.valid_items(n, F.col("shape"), "findings"), "schema_valid": parsed & (F.size("shape") == 0)})
    none = F.array().cast("array<struct<r:int,p:int,score:double>>")
    c = c.withColumn("matches", F.when(F.col("schema_valid"), match.greedy(match.candidates(F.col("own"), F.col("found"), F.col("valid")))).otherwise(none))
    c = c.withColumn("codes", F.concat(F.transform("shape", lambda x: x["code"]), F.transform("cited", lambda x: x["code"]), _prediction_issues(parsed, ["evidence.unparseable-prediction"])))
    c = _measured(c.withColumn("parsed", parsed))
    return c.select(
        "ordinal",
        "id",
        "parsed",
        "schema_valid",
        (F.col("parsed") & (F.size("cited") == 0)).alias("evidence_valid"),
        F.size("own").alias("reference_findings"),
        n.alias("predicted_findings"),
        F.size("shaped").alias("schema_valid_findings"),
        F.size("valid").alias("evidence_valid_findings"),
        F.size("matches").alias("matched_findings"),
        "matches",
        "codes",
        *MEASURES,
    )


MEASURES = ["latency_present", "latency_ms", "cost_present", "cost_usd"]


def _measures(cases: DataFrame) -> list[Column]:
    there = lambda n: F.col(f"{n}_present") if f"{n}_present" in cases.columns else None
    return [*accumulate(F.col("latency_ms"), "latency", there("latency")), *accumulate(F.col("cost_usd"), "cost", there("cost"))]


def review_metrics(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters, rates and latency in one aggregation."""
    clean = F.col("reference_findings") == 0
    total = cases.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"),
        *[F.count_if(c).alias(f"{c}_rows") for c in ("parsed", "schema_valid", "evidence_valid")],
        F.count_if(clean).alias("clean_rows"),
        F.count_if(clean & (F.col("predicted_findings") == 0)).alias("clean_correct"),
        F.count_if(clean & (F.col("predicted_findings") > 0)).alias("clean_false_positives"),
        F.count_if(~clean).alias("nonclean_rows"),
        F.count_if(~clean & (F.col("predicted_findings") > 0)).alias("nonclean_any"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("reference_findings", "predicted_findings", "matched_findings", "schema_valid_findings", "evidence_valid_findings")],
        *_measures(cases),
    )
    return finalize(total)


def finalize(total: DataFrame) -> DataFrame:
    m = total.withColumns({"precision": exprs.ratio(F.col("matched_findings"), F.col("predicted_findings")), "recall": exprs.ratio(F.col("matched_findings"), F.col("reference_findings")), "clean_accuracy": exprs.ratio(F.col("clean_correct"), F.col("clean_rows")), "clean_fp_rate": exprs.ratio(F.col("clean_rows") - F.col("clean_correct"), F.col("clean_rows"))})
    return m.withColumn("f1", exprs.f1(F.col("precision"), F.col("recall")))


def map_cases(cases: DataFrame) -> DataFrame:
    """As review_cases, for features. Only an output of the right shape matches anything."""
    c = cases.withColumns({"predicted": unwrap(F.col("prediction")), "inventory": prompt.paths_in(prompt.walk_strings(prompt.inventory(F.col("prompt"))))})
    c = c.withColumns({"shape": F.when(F.col("predicted").isNotNull(), shapes.map_shape(F.col("predicted"), F.col("inventory"))).otherwise(variants.no_issues()), "own": items(field(F.col("output"), "features")), "found": items(field(F.col("predicted"), "features"))})
    c = c.withColumn("parsed", F.col("predicted").isNotNull())
    c = c.withColumns({"schema_valid": F.col("parsed") & (F.size("shape") == 0), "shaped": evidence.valid_items(F.size("found"), F.col("shape"), "features"), "codes": F.concat(F.transform("shape", lambda x: x["code"]), _prediction_issues(F.col("parsed"), []))})
    c = _measured(c.withColumn("m", F.when(F.col("schema_valid"), match.match_features(F.col("own"), F.col("found")))))
    hits = [F.when(F.col("schema_valid"), F.size(f"m.{k}")).otherwise(0).alias(k) for k in ("exact", "near")]
    return c.select("ordinal", "id", "parsed", "schema_valid", F.size("own").alias("reference_features"), F.size("found").alias("predicted_features"), F.size("shaped").alias("schema_valid_features"), *hits, "codes", *MEASURES)


def map_metrics(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Exact and near-inclusive precision, recall and f1."""
    t = cases.groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.count_if("parsed").alias("parsed_rows"), F.count_if("schema_valid").alias("schema_valid_rows"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("reference_features", "predicted_features", "schema_valid_features", "exact", "near")], *_measures(cases))
    for name, hits in (("exact", F.col("exact")), ("near", F.col("exact") + F.col("near"))):
        t = t.withColumns({f"{name}_precision": exprs.ratio(hits, F.col("predicted_features")), f"{name}_recall": exprs.ratio(hits, F.col("reference_features"))})
        t = t.withColumn(f"{name}_f1", exprs.f1(F.col(f"{name}_precision"), F.col(f"{name}_recall")))
    return t


def revalidate_cases(cases: DataFrame) -> DataFrame:
    """As review_cases, for outcomes. Only an output of the right shape is exact or near."""
    c = cases.withColumn("predicted", unwrap(F.col("prediction")))
    parsed = F.col("predicted").isNotNull()
    c = c.withColumns({"shape": F.when(parsed, shapes.revalidate_shape(F.col("predicted"))).otherwise(variants.no_issues()), "reference_outcome": text(field(F.col("output"), "outcome")), "predicted_outcome": text(field(F.col("predicted"), "outcome"))})
    c = c.withColumns({"parsed": parsed, "schema_valid": parsed & (F.size("shape") == 0), "codes": F.concat(F.transform("shape", lambda x: x["code"]), _prediction_issues(parsed, []))})
    a, b = F.col("reference_outcome"), F.col("predicted_outcome")
    exact, near = F.col("schema_valid") & F.coalesce(a == b, F.lit(False)), F.col("schema_valid") & match.near_outcome(a, b)
    return _measured(c).select("ordinal", "id", "parsed", "schema_valid", a, b, exact.alias("exact"), near.alias("near"), "codes", *MEASURES)


def outcome_counts(cases: DataFrame, column: str) -> DataFrame:
    """outcome, rows: the four outcomes, 0 for those that don't occur, and any other there is."""
    found = cases.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("outcome")).agg(F.count("*").alias("rows"))
    grid = cases.sparkSession.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    return grid.join(found, "outcome", "full").select("outcome", F.coalesce("rows", F.lit(0)).alias("rows"))


def revalidate_metrics(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    t = cases.groupBy(*(by or [])).agg(F.count("*").alias("rows"), *[F.count_if(c).alias(f"{c}_rows") for c in ("parsed", "schema_valid")], F.count_if("exact").alias("exact"), F.count_if("near").alias("near"), *_measures(cases))
    return t.withColumns({"exact_accuracy": exprs.ratio(F.col("exact"), F.col("rows")), "near_accuracy": exprs.ratio(F.col("near"), F.col("rows"))})


# roll-ups


def issue_histogram(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """code, issues."""
    return exprs.unnest(cases, F.col("codes"), "code", *(by or [])).groupBy(*(by or []), "code").agg(F.count("*").alias("issues"))


def issue_categories(histogram: DataFrame) -> DataFrame:
    return histogram.groupBy(F.substring_index("code", ".", 1).alias("category")).agg(F.sum("issues").alias("issues"))


def pair_overlap(cases: DataFrame) -> DataFrame:
    """For each pair of models (columns model, ordinal, matches, …): items found by both, one or neither; clean rows likewise."""
    refs = cases.select("model", "ordinal", "reference_findings", (F.col("predicted_findings") == 0).alias("quiet"), F.transform("matches", lambda m: m["r"]).alias("hits"))
    a, b = refs.alias("a"), refs.alias("b")
    both = a.join(b, (F.col("a.ordinal") == F.col("b.ordinal")) & (F.col("a.model") < F.col("b.model")))
    shared = F.size(F.array_intersect("a.hits", "b.hits"))
    clean = F.col("a.reference_findings") == 0
    return both.groupBy(F.col("a.model").alias("left"), F.col("b.model").alias("right")).agg(
        F.sum(shared).alias("both_matched"),
        F.sum(F.size("a.hits") - shared).alias("left_only"),
        F.sum(F.size("b.hits") - shared).alias("right_only"),
        F.sum(F.col("a.reference_findings") - F.size("a.hits") - F.size("b.hits") + shared).alias("neither_matched"),
        F.count_if(clean & F.col("a.quiet") & F.col("b.quiet")).alias("both_clean"),
        F.count_if(clean & F.col("a.quiet") & ~F.col("b.quiet")).alias("left_clean"),
        F.count_if(clean & ~F.col("a.quiet") & F.col("b.quiet")).alias("right_clean"),
        F.count_if(clean & ~F.col("a.quiet") & ~F.col("b.quiet")).alias("neither_clean"),
    )


def pair_deltas(metrics: DataFrame, names: list[str]) -> DataFrame:
    """left - right of each metric, for each pair of models; null if either is."""
    a, b = metrics.alias("a"), metrics.alias("b")
    return a.join(b, F.col("a.model") < F.col("b.model")).select(F.col("a.model").alias("left"), F.col("b.model").alias("right"), *[exprs.nullable_delta(F.col(f"a.{n}"), F.col(f"b.{n}")).alias(f"delta_{n}") for n in names])


def score_report(operation: str, summary: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row, report: the JSON text of a score report. summary: of reference_summary; metrics: of review_metrics, with label, a row for each model."""
    fields = {**gate.REPORT_FIELDS, **gate.REPORT_RATES}
    model = F.struct("label", F.struct(*[F.col(ours).alias(theirs) for theirs, ours in fields.items()]).alias("metrics"))
    models = metrics.agg(F.array_sort(F.collect_list(model)).alias("models"))
    both = summary.select(F.struct("rows", F.col("parseable").alias("outputParseableRows"), F.col("schema_valid").alias("schemaValidRows"), F.col("clean_rows").alias("cleanRows"), F.col("finding_rows").alias("findingRows"), "findings").alias("reference")).crossJoin(F.broadcast(models))  # one row each
    return both.select(F.to_json(F.struct(F.lit(True).alias("deterministic"), F.lit(operation).alias("operation"), "reference", "models")).alias("report"))


def reference_summary(refs: DataFrame) -> DataFrame:
    """rows, parseable, schema_valid, clean, finding rows and findings. An unreadable reference counts as clean."""
    n = F.size(items(field(F.col("output"), "findings")))
    valid = F.col("output").isNotNull() & (F.size(shapes.review_shape(F.col("output"))) == 0)
    return refs.agg(F.count("*").alias("rows"), F.count_if(F.col("output").isNotNull()).alias("parseable"), F.count_if(valid).alias("schema_valid"), F.count_if(n == 0).alias("clean_rows"), F.count_if(n > 0).alias("finding_rows"), F.coalesce(F.sum(n), F.lit(0)).alias("findings"))


