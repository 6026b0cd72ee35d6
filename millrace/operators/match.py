"""Scores between predicted and reference items, and one-to-one matching within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.constants import MATCH_FEATURE, MATCH_FINDING
from millrace.functions import exprs
from millrace.functions.variants import field, items, text
from millrace.operators.evidence import line_range


def pair_score(same_path: Column, a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    """Of two pieces of evidence: overlap from 0.55 to 0.7, near 0.4 (5 lines) or 0.25 (20), else 0.2 on the same path."""
    overlap = F.least(a_last, b_last) - F.greatest(a_first, b_first) + 1
    longest = F.greatest(a_last - a_first + 1, b_last - b_first + 1, F.lit(1))
    gap = F.greatest(a_first, b_first) - F.least(a_last, b_last)
    usable = a_first.isNotNull() & a_last.isNotNull() & b_first.isNotNull() & b_last.isNotNull()
    near = F.when(gap <= 5, F.lit(0.4)).when(gap <= 20, F.lit(0.25)).otherwise(F.lit(0.2))
    on_path = F.when(~usable, F.lit(0.2)).when(overlap > 0, F.lit(0.55) + F.least(F.lit(0.15), F.lit(0.15) * overlap / longest)).otherwise(near)
    return F.when(same_path, on_path).otherwise(F.lit(0.0))


def finding_score(evidence: Column, title: Column, same_category: Column, same_severity: Column) -> Column:
    """evidence: the best pair's score; title: similarity of the titles' words."""
    added = evidence + F.least(F.lit(0.2), F.lit(0.2) * title) + F.when(same_category, F.lit(0.15)).otherwise(F.lit(0.0)) + F.when(same_severity, F.lit(0.1)).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(1.0), added), 6)


def _evidence(f: Column) -> Column:
    def one(e: Column) -> Column:
        r = line_range(e)
        return F.struct(F.coalesce(exprs.normalize_path(text(field(e, "path"))), F.lit("")).alias("path"), r["first"].alias("first"), r["last"].alias("last"))

    return F.transform(items(field(f, "evidence")), one)


def best_evidence(a: Column, b: Column) -> Column:
    """Highest pair score of two findings' evidence; 0 without any."""
    every = F.flatten(F.transform(_evidence(a), lambda x: F.transform(_evidence(b), lambda y: pair_score(x["path"] == y["path"], x["first"], x["last"], y["first"], y["last"]))))
    return F.coalesce(F.array_max(every), F.lit(0.0))


def findings_score(reference: Column, predicted: Column) -> Column:
    titles = exprs.jaccard(exprs.title_tokens(F.coalesce(text(field(reference, "title")), F.lit(""))), exprs.title_tokens(F.coalesce(text(field(predicted, "title")), F.lit(""))))

    def same(name: str) -> Column:
        return F.coalesce(text(field(reference, name)) == text(field(predicted, name)), F.lit(False))

    return finding_score(best_evidence(reference, predicted), titles, same("category"), same("severity"))


def pairs_in_blocks(rows: DataFrame, key: str, block: list[str], value: str, score, most: int = 4096) -> DataFrame:
    """left_key < right_key, score: all pairs of rows of equal block columns. score(a, b): symmetric, of two values; null where one is null.

    It is made once for two different values of a block, however many rows have them, and the rows' pairs are then written out. A block
    is dealt into parts of about `most` rows by the key's hash, and each two of its parts meet by themselves: no task holds all pairs of a large block.
    """
    rows = rows.select(F.col(key).alias("k"), *block, F.col(value).alias("v")).where(" AND ".join(f"{c} IS NOT NULL" for c in ("k", *block)))
    cells = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    parts = rows.groupBy(*block).agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    groups = rows.join(parts, block).groupBy(*block, "parts", F.pmod(F.xxhash64("k"), "parts").cast("int").alias("part"), "v").agg(F.collect_list("k").alias("ks"))

    def side(other: Column, low: str, high: str, name: str) -> DataFrame:
        dealt = groups.select(*block, F.struct("v").alias(f"v{name}"), F.col("ks").alias(f"k{name}"), "part", F.explode(other).alias("other"))
        return dealt.select("*", F.col(low).alias("low"), F.col(high).alias("high")).drop("part", "other").repartition(cells, *block, "low", "high")

    left = side(F.sequence(F.col("part"), F.col("parts") - 1), "part", "other", "a")
    right = side(F.sequence(F.lit(0), F.col("part")), "other", "part", "b")
    met = left.hint("merge").join(right, [*block, "low", "high"]).where("low < high OR va <= vb")
    scored = met.select("ka", "kb", (F.expr("low = high AND va = vb")).alias("own"), F.when(F.col("va.v").isNotNull() & F.col("vb.v").isNotNull(), score(F.col("va.v"), F.col("vb.v"))).alias("score"))
    out = scored.select("score", "own", "kb", F.explode("ka").alias("a")).select("score", "own", "a", F.explode("kb").alias("b"))
    # within one group each pair comes both ways
    return out.where("a < b OR (a > b AND NOT own)").select(F.least("a", "b").alias("left_key"), F.greatest("a", "b").alias("right_key"), "score")


def greedy(candidates: Column) -> Column:
    """One-to-one choice from array<struct<score, p, r>>: highest score first, then smaller p, then smaller r; in order of (r, p).

    Bounded by a row's items; runs inside the row, without a shuffle.
    """
    ordered = F.array_sort(F.transform(candidates, lambda c: F.struct((-c["score"]).alias("s"), c["p"].cast("int").alias("p"), c["r"].cast("int").alias("r"))))
    start = F.array().cast("array<struct<r:int,p:int,score:double>>")

    def take(acc: Column, c: Column) -> Column:
        used = F.exists(acc, lambda m: (m["p"] == c["p"]) | (m["r"] == c["r"]))
        return F.when(used, acc).otherwise(F.concat(acc, F.array(F.struct(c["r"].alias("r"), c["p"].alias("p"), (-c["s"]).cast("double").alias("score")))))

    return F.array_sort(F.aggregate(ordered, start, take))


def two_stage(exact: Column, near: Column, threshold: float = MATCH_FEATURE) -> Column:
    """Exact pairs first (array<struct<score, p, r>>, score higher for a better kind), then near ones among what is left."""
    first = greedy(exact)
    rest = F.filter(near, lambda c: (c["score"] >= threshold) & ~F.exists(first, lambda m: (m["p"] == c["p"]) | (m["r"] == c["r"])))
    return F.struct(first.alias("exact"), greedy(rest).alias("near"))


def candidates(reference: Column, predicted: Column, usable: Column, threshold: float = MATCH_FINDING) -> Column:
    """Pairs of findings at the threshold or above; usable: indexes of predictions that may match."""
    every = F.flatten(F.transform(predicted, lambda p, i: F.transform(reference, lambda r, j: F.struct(F.when(F.array_contains(usable, i), findings_score(r, p)).otherwise(F.lit(-1.0)).alias("score"), i.alias("p"), j.alias("r")))))
    return F.filter(every, lambda c: c["score"] >= threshold)


def paths_of(feature: Column, names: list[str]) -> Column:
    every = F.flatten(F.array(*[F.transform(items(field(feature, n)), lambda x: exprs.normalize_path(text(field(x, "path")))) for n in names]))
    return F.array_distinct(F.filter(every, lambda p: p.isNotNull() & (p != "")))


def feature_score(owned_a: Column, owned_b: Column, all_a: Column, all_b: Column) -> Column:
    """Near score of two features from their path sets."""
    return F.round(F.greatest(exprs.jaccard(owned_a, owned_b), F.lit(0.8) * exprs.jaccard(all_a, all_b)), 6)


def match_features(reference: Column, predicted: Column) -> Column:
    """struct<exact, near> for arrays of features (VARIANT)."""
    owned = ["ownedFiles"]
    every = ["ownedFiles", "entrypoints", "contextFiles", "tests"]

    def pair(p: Column, i: Column, r: Column, j: Column) -> Column:
        same_id = (F.coalesce(text(field(p, "featureId")), F.lit("")) != "") & F.coalesce(text(field(p, "featureId")) == text(field(r, "featureId")), F.lit(False))
        a, b = paths_of(r, owned), paths_of(p, owned)
        kind = F.when(same_id, F.lit(2.0)).when((F.size(a) > 0) & exprs.same_set(a, b), F.lit(1.0)).otherwise(F.lit(0.0))
        return F.struct(kind.alias("exact"), feature_score(a, b, paths_of(r, every), paths_of(p, every)).alias("near"), i.alias("p"), j.alias("r"))

    pairs = F.flatten(F.transform(predicted, lambda p, i: F.transform(reference, lambda r, j: pair(p, i, r, j))))

    def of(x: Column) -> Column:
        exact = F.transform(F.filter(x, lambda c: c["exact"] > 0), lambda c: F.struct(c["exact"].alias("score"), c["p"], c["r"]))
        near = F.transform(x, lambda c: F.struct(c["near"].alias("score"), c["p"], c["r"]))
        return two_stage(exact, near)

    return exprs.let(pairs, of)


def near_outcome(a: Column, b: Column) -> Column:
    return F.coalesce((a == b) | (exprs.outcome_class(a) == exprs.outcome_class(b)), F.lit(False))
