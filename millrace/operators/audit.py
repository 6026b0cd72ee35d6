"""Coverage roll-ups, gaps to targets, and the plan of the next capture batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.constants import LEAST_REPOS, OPERATIONS, PER_REPO, TARGETS
from millrace.functions import exprs, variants
from millrace.operators.curate import last_by_key


def audit_projection(rows: DataFrame, operation: str, split: str, repo: str, finding_count: str, capture_id: str) -> DataFrame:
    return rows.select(
        exprs.safe_label(F.col(capture_id).cast("string")).alias("id"),
        exprs.one_of(F.col(operation), OPERATIONS).alias("operation"),
        exprs.safe_label(F.col(split)).alias("split"),
        exprs.safe_label(F.col(repo)).alias("repo"),
        F.col(finding_count).alias("finding_count"),
    )


def coverage(rows: DataFrame) -> DataFrame:
    """operation, split, repo (null: all of them), rows, clean, nonempty, unknown: by each, by all three, and in total."""
    sets = [[F.col("operation")], [F.col("split")], [F.col("repo")], [F.col("operation"), F.col("split"), F.col("repo")], []]
    return rows.groupingSets(sets, "operation", "split", "repo").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("finding_count") == 0).alias("clean"),
        F.count_if(F.col("finding_count") > 0).alias("nonempty"),
        F.count_if(F.col("finding_count").isNull() | (F.col("finding_count") < 0)).alias("unknown"),
    )


def capture_projection(captures: DataFrame) -> DataFrame:
    """Captures (with the fields of curate.CAPTURE) as id, operation, repo, status, validation_status, redacted, metadata_only."""
    return captures.select(
        exprs.safe_label(F.col("captureId")).alias("id"),
        exprs.safe_label(F.col("operation")).alias("operation"),
        exprs.safe_label(F.col("repo.projectName")).alias("repo"),
        exprs.safe_label(F.col("status")).alias("status"),
        exprs.safe_label(F.col("validationStatus")).alias("validation_status"),
        F.coalesce("redactionState.redacted", F.lit(False)).alias("redacted"),
        F.coalesce("redactionState.metadataOnly", F.lit(False)).alias("metadata_only"),
    )


def planner_projection(rows: DataFrame) -> DataFrame:
    """Chat rows' metadata (VARIANT) as id, operation (one of the known ones, else unknown), repo, finding_count, redacted, metadata_only."""
    m = F.col("metadata")
    text = lambda v: variants.text(v)
    repo = variants.field(m, "repo")
    project = lambda n: F.when(F.length(text(variants.field(repo, n))) > 0, text(variants.field(repo, n)))
    true = lambda n: F.coalesce((variants.kind(variants.field(m, n)) == "boolean") & F.try_variant_get(m, f"$.{n}", "boolean"), F.lit(False))
    return rows.select(
        exprs.safe_label(text(variants.field(m, "captureId"))).alias("id"),
        exprs.one_of(text(variants.field(m, "operation")), OPERATIONS).alias("operation"),
        exprs.safe_label(F.when(variants.kind(repo) == "object", F.coalesce(project("projectName"), project("name"))).otherwise(text(repo))).alias("repo"),
        variants.whole(variants.field(m, "findingCount")).alias("finding_count"),
        true("redacted").alias("redacted"),
        true("metadataOnly").alias("metadata_only"),
        *[c for c in rows.columns if c != "metadata"],
    )


def counted(value: Column, default: Column) -> Column:
    """A VARIANT that is a whole number from 0, else the default."""
    return exprs.let(variants.whole(value), lambda n: exprs.non_negative_integer(n, default))


def normalized_counts(counts: Column) -> Column:
    """struct<total, review, map, revalidate> of a report's counts (VARIANT): 0 for what is no whole number from 0; a total that isn't there is the sum of the operations."""
    by = variants.field(counts, "byOperation")
    names = F.map_from_arrays(F.array(*map(F.lit, OPERATIONS)), F.array(*[counted(variants.field(by, o), F.lit(0).cast("long")) for o in OPERATIONS]))
    return exprs.let(names, lambda m: F.struct(counted(variants.field(counts, "total"), map_value_sum(m)).alias("total"), *[m[o].alias(o) for o in OPERATIONS]))


def map_value_sum(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)


def deduplicated(rows: DataFrame, order: list[str]) -> DataFrame:
    """The last row of each operation, id and repo, in ascending order."""
    return last_by_key(rows, ["operation", "id", "repo"], order)


def capture_rollup(rows: DataFrame, columns: list[str], flags: list[str]) -> DataFrame:
    """facet, value, rows and a count for each flag, by each of the columns."""
    out = rows.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count("*").alias("rows"), *[F.count_if(f).alias(f) for f in flags], *[F.grouping(c).alias(f"g_{c}") for c in columns])
    facet, value = F.lit(""), F.lit("")
    for c in columns:
        facet = F.when(F.col(f"g_{c}") == 0, c).otherwise(facet)
        value = F.when(F.col(f"g_{c}") == 0, exprs.safe_label(F.col(c).cast("string"))).otherwise(value)
    return out.select(facet.alias("facet"), value.alias("value"), "rows", *flags)


def repository_summary(rows: DataFrame) -> DataFrame:
    """known_repos, unknown_rows, total_rows."""
    by_repo = rows.groupBy(exprs.safe_label(F.col("repo")).alias("repo")).agg(F.count("*").alias("n"))
    return by_repo.agg(F.count_if(F.col("repo") != "unknown").alias("known_repos"), F.coalesce(F.sum(F.when(F.col("repo") == "unknown", F.col("n"))), F.lit(0)).alias("unknown_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"))


def gaps(counts: DataFrame, targets: dict[str, int] | None = None, key: str = "operation") -> DataFrame:
    """key, current, target, gap, met for each target. counts: key, rows."""
    spark = counts.sparkSession
    goal = spark.createDataFrame(list((TARGETS if targets is None else targets).items()), f"{key} string, target long")
    current = F.coalesce("rows", F.lit(0))
    return goal.join(counts.select(key, "rows"), key, "left").select(key, current.alias("current"), "target", exprs.bounded_gap(F.col("target"), current).alias("gap"), (current >= F.col("target")).alias("met"))


def plan(spark: SparkSession, current: DataFrame, per_repo: dict[str, int] | None = None, least_repos: int = LEAST_REPOS) -> DataFrame:
    """One row: how many new repositories, of which kind, with how many captures each.

    current: review, revalidate, map (counts so far), known_repos, nonempty, and optionally targets as t_review and so on.
    """
    each = PER_REPO if per_repo is None else per_repo
    g = {}
    for name in OPERATIONS:
        target = F.coalesce(F.col(f"t_{name}"), F.lit(TARGETS[name])) if f"t_{name}" in current.columns else F.lit(TARGETS[name])
        g[name] = exprs.bounded_gap(target, F.coalesce(F.col(name), F.lit(0)))
    reviews = exprs.ceil_divide(g["review"], F.lit(each["review"]))
    blocked = (g["revalidate"] > 0) & (F.coalesce(F.col("nonempty"), F.lit(0)) <= 0)
    rechecks = F.when(blocked, F.lit(0)).otherwise(exprs.ceil_divide(g["revalidate"], F.lit(each["revalidate"])))
    maps = exprs.ceil_divide(g["map"], F.lit(each["map"]))
    diversity = exprs.bounded_gap(F.lit(least_repos), F.coalesce(F.col("known_repos"), F.lit(0)))
    base = current.select(*[x.alias(f"gap_{n}") for n, x in g.items()], F.greatest(reviews, rechecks, maps, diversity.cast("long")).alias("new_repos"), reviews.alias("r"), rechecks.alias("v"), blocked.alias("revalidate_blocked"))
    base = base.withColumn("heavy_repos", F.least("new_repos", F.greatest("r", "v"))).withColumn("map_only_repos", F.col("new_repos") - F.col("heavy_repos"))
    spread = {n: exprs.distribute_evenly(F.col(f"gap_{n}"), F.col("heavy_repos" if n != "map" else "new_repos")) for n in OPERATIONS}
    return base.select(*[f"gap_{n}" for n in OPERATIONS], "new_repos", "heavy_repos", "map_only_repos", "revalidate_blocked", *[c for n, x in spread.items() for c in (x["min"].alias(f"{n}_min"), x["max"].alias(f"{n}_max"))])


def priorities(current: DataFrame) -> DataFrame:
    """operation, rank, gap, blocked in the fixed order of work; current is a row of plan."""
    rows = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(n).alias("operation"), F.col(f"gap_{n}").alias("gap"), (F.col("revalidate_blocked") if n == "revalidate" else F.lit(False)).alias("blocked")) for i, n in enumerate(["review", "revalidate", "map"])])
    return current.select(F.explode(rows).alias("p")).select("p.*")
