"""URL filters by expanded expressions and short hash prefixes.

Each URL is expanded into host suffixes (label by label) joined with path prefixes (one
for each length that the rules' paths have), as lookup lists of unsafe sites do. A
four-byte prefix of each expression's SHA-256 is the join key; then the full digest
confirms the match and the longest rule decides. DataFrame functions only.

Null or odd input: a null url, or one without ://, has an empty host and path, fits no rule
and gets the default verdict. Repeated rows stay repeated. No rules: all rows get the
default. Rules that are given twice count once; of one rule with both verdicts, block wins.
Extra columns of pages are kept, but for those that the operator makes itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh, stage_table

#: Rows without a host are dealt over so many parts.
SALTS = 1024
#: Rules up to so many bytes (see rule_bytes) are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 8 << 20
MADE = ("host", "path", "rule", "verdict")


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    u = F.col(f"`{url}`")
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.withColumns(
        {
            "host": F.coalesce(F.translate(host, upper, lower), F.lit("")),
            "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
        }
    )


def host_suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def key_of(expression: Column) -> tuple[Column, Column]:
    """The short prefix that the join uses, and the full digest."""
    digest = F.sha2(expression, 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), digest


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (host and path of the longest rule that fits, else null) and verdict.

    rules: host, path, verdict (allow or block). A rule fits its host and all its
    subdomains, if the url's path starts with the rule's path.
    """
    rules = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != ""))
        .groupBy("host", "path")
        .agg(F.max(F.col("verdict") == "block").alias("_blocks"))
        .select(F.concat("host", "path").alias("_rule"), F.struct("host", "path").alias("_parts"), "_blocks", F.length("path").alias("_len"))
    )
    # one row: distinct lengths of the rules' paths, at most as many as a path has characters
    stats = rules.agg(F.sort_array(F.collect_set("_len")).alias("lens"), F.coalesce(F.sum(F.length("_rule") + 96), F.lit(0)).alias("bytes")).first()
    lengths, rule_bytes = list(stats["lens"]), stats["bytes"]
    base = with_host_path(pages.drop(*[c for c in MADE if c in pages.columns and c != url]), url)
    if not lengths:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    h, d = key_of(F.to_json("_parts"))
    keyed = rules.select(h.alias("_key"), d.alias("_digest"), "_rule", "_blocks")
    # host and path pairs repeat; each is looked up once, with partial results before the shuffle
    sites = base.select("host", "path").where("host != ''").distinct()
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    exprs = sites.select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("_h"), F.array_compact(prefixes).alias("_ps"))
    exprs = exprs.select("host", "path", "_h", F.explode("_ps").alias("_p"))
    eh, ed = key_of(F.to_json(F.struct(F.col("_h").alias("host"), F.col("_p").alias("path"))))
    exprs = exprs.select("host", "path", eh.alias("_key"), ed.alias("_full"))
    side = F.broadcast(keyed) if rule_bytes <= BROADCAST_BYTES else keyed
    hits = exprs.join(side, "_key").where(F.col("_full") == F.col("_digest"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("_rule").alias("n"), F.col("_blocks").alias("b"), F.col("_rule").alias("r"))).alias("_best"))
    # a table of its own, joined by shuffle as it grows with the pages: pages of one hot host and path may be split over tasks there. Rows without a
    # host fit nothing, and are dealt out
    salt, found = fresh(base, "_salt"), fresh(base, "_best")
    best = stage_table(best.select("host", "path", F.lit(-1).cast("long").alias(salt), F.col("_best").alias(found)), "url-rules")
    dealt = F.when(F.col("host") == "", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(-1)).cast("long")
    out = base.withColumn(salt, dealt).join(best.hint("merge"), ["host", "path", salt], "left")
    hit = F.col(f"`{found}`")
    verdict = F.when(hit.isNull(), F.lit(default)).otherwise(F.when(hit["b"], F.lit("block")).otherwise(F.lit("allow")))
    kept = [F.col(f"`{c}`") for c in base.columns]
    return out.select(*kept, hit["r"].alias("rule"), verdict.alias("verdict"))
