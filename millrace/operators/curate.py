"""Accepted captures to chat rows: usability, projection, splits, the hard-boundary subset, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.constants import HARD_CLEAN, HARD_NONEMPTY, REPO_SPLITS, SPLITS
from millrace.functions import exprs, variants

#: Fields of a capture that curation reads.
CAPTURE = (
    "captureId string, captureRunId string, operation string, repo struct<projectName:string,headSha:string>, provider struct<name:string,model:string>, "
    "status string, validationStatus string, redactionState struct<redacted:boolean,metadataOnly:boolean>, prompt string, acceptedOutput variant"
)


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds, or null."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def unusable_because(c: DataFrame) -> Column:
    return first_reason(
        ("non-accepted-status", ~c["status"].eqNullSafe("accepted")),
        ("not-schema-valid-operation-valid", ~c["validationStatus"].eqNullSafe("schema-valid-operation-valid")),
        ("metadata-only", c["redactionState.metadataOnly"]),
        ("missing-prompt", c["prompt"].isNull() | (F.length("prompt") == 0)),
        ("missing-accepted-output", c["acceptedOutput"].isNull() | F.is_variant_null("acceptedOutput")),
    )


def usable(captures: DataFrame) -> DataFrame:
    return captures.where(unusable_because(captures).isNull())


def excluded_counts(captures: DataFrame) -> DataFrame:
    """reason, rows."""
    return captures.select(unusable_because(captures).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("rows"))


def finding_count(output: Column) -> Column:
    """How many findings an output has; -1 without an array of them."""
    return F.coalesce(F.size(F.try_variant_get(variants.field(output, "findings"), "$", "array<variant>")), F.lit(-1))


def split_of(repo: Column, operation: Column, ordinal: Column, repo_splits: dict[str, str] | None = None, alternating: str = "ripgrep") -> Column:
    """A repo's split; reviews of the alternating repo go to validation and test in turn; unknown repos to test."""
    out = F.lit("test")
    for name, split in (REPO_SPLITS if repo_splits is None else repo_splits).items():
        out = F.when(repo == name, split).otherwise(out)
    return F.when((repo == alternating) & (operation == "review"), F.when(ordinal % 2 == 0, "validation").otherwise("test")).otherwise(out)


def with_ordinal_by_id(rows: DataFrame, keys: list[str], order: str, width: int = 100_000, name: str = "ordinal") -> DataFrame:
    """The 0-based place of each row within its keys, by a whole-number order: numbered within stretches of it, then shifted by the counts before.

    A group of any size is dealt over its stretches; only their counts are ordered as a whole.
    """
    cut = rows.withColumn("_part", F.floor(F.col(order) / width))
    counts = cut.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = counts.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = cut.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order)) - 1)
    shift = shift.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_before")
    same = F.col("_part").eqNullSafe(F.col("_p"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))  # rows without a key are a group too
    return placed.join(shift, same).withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_before", "_at", "_p", *[f"_k{i}" for i in range(len(keys))])


def curated(captures: DataFrame, order: str, system_prompt: str, output_json: str = "acceptedJson", repo_splits: dict[str, str] | None = None, alternating: str = "ripgrep") -> DataFrame:
    """Chat rows of usable captures: messages, metadata, split. order: a whole number that gives the input order (of several
    sources: the source's number times a bound, plus the line). output_json: column with the output's text as it was written.
    """
    rows = usable(captures).withColumns({"_repo": F.col("repo.projectName"), "_op": F.col("operation")})
    rows = with_ordinal_by_id(rows, ["_repo", "_op"], order)
    meta = F.struct(
        "captureId",
        "captureRunId",
        "operation",
        F.col("_repo").alias("repo"),
        F.col("repo.headSha").alias("repoHeadSha"),
        F.col("provider.name").alias("provider"),
        F.coalesce("provider.model", F.lit("")).alias("providerModel"),
        "validationStatus",
        F.coalesce("redactionState.redacted", F.lit(False)).alias("redacted"),
        F.coalesce("redactionState.metadataOnly", F.lit(False)).alias("metadataOnly"),
        exprs.utf8_len(F.col("prompt")).alias("promptBytes"),
        exprs.utf8_len(F.col(output_json)).alias("assistantBytes"),
        F.coalesce(variants.text(variants.field(F.col("acceptedOutput"), "featureId")), F.lit("")).alias("featureId"),
        finding_count(F.col("acceptedOutput")).alias("findingCount"),
        *[F.lit("").alias(n) for n in ("evalKind", "triageStatus", "triageReviewerOrMethod", "triageNotes")],
        *[F.lit(False).alias(n) for n in ("expectedJsonParse", "expectedSchemaValid", "expectedEvidenceValid")],
    )
    return rows.select(messages_of(F.lit(system_prompt), F.col("prompt"), F.col(output_json)).alias("messages"), meta.alias("metadata"), split_of(F.col("_repo"), F.col("_op"), F.col("ordinal"), repo_splits, alternating).alias("split"))


def messages_of(system: Column, user: Column, assistant: Column) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in (("system", system), ("user", user), ("assistant", assistant))])


def last_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys, the last in ascending order: a maximum, with partial results before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(last.alias("_last")).select(*[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in rows.columns])


def sort_key() -> list[Column]:
    """repo, operation and id in one text, in dictionary order."""
    parts = [F.coalesce(F.col(c), F.lit("null")) for c in ("metadata.repo", "metadata.operation", "metadata.captureId")]
    return [F.collate(F.concat_ws(":", *parts), "UNICODE")]


def hard_boundary(rows: DataFrame, triage: DataFrame, clean: int = HARD_CLEAN, nonempty: int = HARD_NONEMPTY) -> DataFrame:
    """Triaged rows: all that aren't reviews, the first clean and the first non-empty reviews. triage's `ordinal`: its last row counts.

    Each class's first rows are a top-k; rows that aren't reviews aren't sorted.
    """
    last = last_by_key(triage, ["captureId"], ["ordinal"]).select(F.col("captureId").alias("_id"), *[F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in ("triageStatus", "triageReviewerOrMethod", "triageNotes")])
    found = rows.join(last, F.col("metadata.captureId") == F.col("_id"))
    review, count = F.col("metadata.operation") == "review", F.col("metadata.findingCount")
    firsts = [found.where(review & holds).orderBy(*sort_key()).limit(n) for holds, n in ((count == 0, clean), (count > 0, nonempty))]
    found = found.where(~F.coalesce(review, F.lit(False))).union(firsts[0]).union(firsts[1])
    meta = F.col("metadata").withField("evalKind", F.lit("hard_boundary"))
    for name in ("triageStatus", "triageReviewerOrMethod", "triageNotes"):
        meta = meta.withField(name, F.col(f"_{name}"))
    for name in ("expectedJsonParse", "expectedSchemaValid", "expectedEvidenceValid"):
        meta = meta.withField(name, F.lit(True))
    return found.select("messages", meta.alias("metadata"), F.lit("hard_boundary").alias("split"))


def split_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts by every one of the columns in by, and in all, for each split. rows: split, findingCount, redacted and by."""
    sets = [["split"], *[["split", b] for b in by]]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], F.col("split"), *[F.col(b) for b in by]).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("findingCount") == 0).alias("clean"),
        F.count_if(F.col("findingCount") > 0).alias("nonempty"),
        F.count_if("redacted").alias("redacted"),
        *[F.grouping(b).alias(f"g_{b}") for b in by],
    )
    facet, value = F.lit("all"), F.lit("")
    for b in by:
        facet = F.when(F.col(f"g_{b}") == 0, b).otherwise(facet)
        value = F.when(F.col(f"g_{b}") == 0, F.coalesce(F.col(b), F.lit("null"))).otherwise(value)
    return out.select("split", facet.alias("facet"), value.alias("value"), "rows", "clean", "nonempty", "redacted")


def zero_filled(rows: DataFrame, names: list[str], column: str = "split") -> DataFrame:
    """Rows of each name, 0 for those without."""
    grid = rows.sparkSession.createDataFrame([(n,) for n in names], f"{column} string")
    return grid.join(rows.groupBy(column).agg(F.count("*").alias("rows")), column, "left").select(column, F.coalesce("rows", F.lit(0)).alias("rows"))


def operation_subset(rows: DataFrame, operation: str) -> DataFrame:
    return rows.where(F.col("metadata.operation") == operation)


def all_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("split").isin(SPLITS)).withColumn("split", F.lit("all"))
