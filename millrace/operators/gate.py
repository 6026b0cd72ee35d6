"""Thresholds on review metrics, and where failures come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.constants import THRESHOLDS
from millrace.functions import exprs, variants


def check_thresholds(thresholds: dict[str, float]) -> dict[str, float]:
    for name, value in thresholds.items():
        if name not in THRESHOLDS or not 0 <= value <= 1:
            raise ValueError(f"threshold {name}={value} must be one of {sorted(THRESHOLDS)} and from 0 to 1")
    return THRESHOLDS | thresholds


#: Fields of a model's metrics in a score report, and what they are called here.
REPORT_FIELDS = {
    "referenceRows": "rows",
    "outputParseableRows": "parsed_rows",
    "schemaValidRows": "schema_valid_rows",
    "evidenceValidRows": "evidence_valid_rows",
    "cleanReferenceRows": "clean_rows",
    "cleanCorrectRows": "clean_correct",
    "referenceFindings": "reference_findings",
    "predictedFindings": "predicted_findings",
    "matchedFindings": "matched_findings",
}
REPORT_RATES = {"precision": "precision", "recall": "recall", "f1": "f1", "cleanAccuracy": "clean_accuracy"}


def _required(holds: Column, value: Column, message: str) -> Column:
    return F.when(F.coalesce(holds, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def _counted(metrics: Column, name: str, whole: bool) -> Column:
    """A field's number; fails if it isn't one, or isn't a whole one from 0."""
    kind = "long" if whole else "double"
    wrong = F.raise_error(F.lit(f"metrics.{name} isn't a number that counts")).cast(kind)

    def checked(n: Column) -> Column:
        good = (n >= 0) & (n == F.floor(n)) if whole else n.isNotNull()
        return F.when(F.coalesce(good, F.lit(False)), n.cast(kind)).otherwise(wrong)

    return exprs.let(variants.number(variants.field(metrics, name)), checked)


def score_report(reports: DataFrame) -> DataFrame:
    """A row for each model of score reports (value: VARIANT): operation, label, counters and rates.

    A report must say that it is deterministic, name its operation and have a model; counters must be whole numbers from 0 and rates numbers. Anything else fails.
    """
    v = F.col("value")
    models = variants.items(variants.field(v, "models"))
    operation = variants.text(variants.field(v, "operation"))
    fit = (variants.kind(variants.field(v, "deterministic")) == "boolean") & F.try_variant_get(v, "$.deterministic", "boolean")
    checked = _required(fit, operation, "a score report must be deterministic")
    checked = _required((F.length(operation) > 0) & (F.size(models) > 0), checked, "a score report must name its operation and have a model")
    rows = reports.select(checked.alias("operation"), F.explode_outer(models).alias("model"))
    metrics = variants.field(F.col("model"), "metrics")
    cells = [_counted(metrics, theirs, True).alias(ours) for theirs, ours in REPORT_FIELDS.items()]
    cells += [_counted(metrics, theirs, False).alias(ours) for theirs, ours in REPORT_RATES.items()]
    label = variants.text(variants.field(F.col("model"), "label"))
    return rows.select("operation", _required(F.length(label) > 0, label, "a model must have a label").alias("label"), *cells)


def quality_gate(metrics: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """metrics (of review_metrics) with rates, a pass for each threshold, and passed. Review only: other metrics raise."""
    limits = check_thresholds(thresholds or {})
    missing = {"schema_valid_rows", "evidence_valid_rows", "clean_accuracy"} - set(metrics.columns)
    if missing:
        raise ValueError(f"the gate needs review metrics; missing {sorted(missing)}")
    m = metrics.withColumns({f"{n}_rate": exprs.ratio_or_null(F.col(f"{n}_rows"), F.col("rows")) for n in ("parsed", "schema_valid", "evidence_valid")})
    checks = {"f1": F.col("f1"), "cleanAccuracy": F.col("clean_accuracy"), "schemaValidRate": F.col("schema_valid_rate"), "evidenceValidRate": F.col("evidence_valid_rate")}
    m = m.withColumns({f"{n}_passed": F.coalesce(exprs.meets(c, limits[n]), F.lit(False)) for n, c in checks.items()})
    every: Column = F.lit(True)
    for n in checks:
        every = every & F.col(f"{n}_passed")
    return m.withColumn("passed", every)


def all_passed(gated: DataFrame) -> DataFrame:
    """One row; no models is an error, not a pass."""
    return gated.agg(F.when(F.count("*") == 0, F.raise_error(F.lit("no models to judge")).cast("boolean")).otherwise(F.bool_and("passed")).alias("passed"))


def exit_code(gated: DataFrame) -> int:
    return 0 if all_passed(gated).first()["passed"] else 1


def triage(metrics: DataFrame, histogram: DataFrame) -> DataFrame:
    """Gaps behind a failed gate, for one model: schema, evidence, clean rows, recall; with issue counts by prefix."""
    counts = histogram.agg(F.coalesce(F.sum("issues"), F.lit(0)).alias("issues"), *[F.coalesce(F.sum(F.when(F.col("code").startswith(f"{p}."), F.col("issues"))), F.lit(0)).alias(f"{p}_issues") for p in ("schema", "evidence", "prediction")])
    t = metrics.crossJoin(F.broadcast(counts))  # one row
    return t.select(
        "rows",
        "issues",
        "schema_issues",
        "evidence_issues",
        "prediction_issues",
        exprs.ratio(F.col("issues"), F.col("rows")).alias("issues_per_row"),
        exprs.bounded_gap(F.col("rows"), F.col("parsed_rows")).alias("unparseable_rows"),
        exprs.bounded_gap(F.col("rows"), F.col("schema_valid_rows")).alias("invalid_schema_rows"),
        exprs.ratio(exprs.bounded_gap(F.col("rows"), F.col("schema_valid_rows")), F.col("rows")).alias("invalid_schema_rate"),
        exprs.bounded_gap(F.col("predicted_findings"), F.col("schema_valid_findings")).alias("invalid_schema_items"),
        exprs.bounded_gap(F.col("predicted_findings"), F.col("evidence_valid_findings")).alias("invalid_evidence_items"),
        (F.col("clean_rows") - F.col("clean_correct")).alias("clean_false_positives"),
        exprs.bounded_gap(F.col("reference_findings"), F.col("matched_findings")).alias("missed_items"),
        exprs.ratio(exprs.bounded_gap(F.col("reference_findings"), F.col("matched_findings")), F.col("reference_findings")).alias("missed_rate"),
    )
