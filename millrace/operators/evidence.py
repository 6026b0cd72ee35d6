"""Evidence of findings against the prompt they came from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import exprs
from millrace.functions.exprs import let
from millrace.functions.variants import field, issue, items, kind, no_issues, number, text

_P = "evidence."


def line_range(v: Column) -> Column:
    """struct<first, last, error>: 0 counts as null; both null is no range."""

    def end(name: str) -> Column:
        # what is there, its number (null for 0), and whether it can be a line number at all
        def of(f: Column) -> Column:
            return F.struct(kind(f).alias("k"), number(f).alias("n"))

        return let(field(v, name), of)

    def of(ends: Column) -> Column:
        a, b = ends["a"], ends["b"]
        first, last = F.when(a["n"] != 0, a["n"]), F.when(b["n"] != 0, b["n"])
        none = a["k"].isin("null", "number") & b["k"].isin("null", "number") & first.isNull() & last.isNull()
        whole = (first == F.floor(first)) & (last == F.floor(last))
        error = (
            F.when(none, F.lit(None).cast("string"))
            .when(~F.coalesce(whole, F.lit(False)), "range-incomplete")
            .when((first <= 0) | (last <= 0), "range-not-positive")
            .when(first > last, "range-inverted")
        )
        return let(error, lambda e: F.struct(F.when(e.isNull(), first.cast("long")).alias("first"), F.when(e.isNull(), last.cast("long")).alias("last"), e.alias("error")))

    return let(F.struct(end("startLine").alias("a"), end("endLine").alias("b")), of)


def shown(lines: Column, first: Column, last: Column) -> Column:
    """Whether every line of the range is among the block's lines. Counts, so that a huge claimed range costs nothing."""
    own = F.array_distinct(F.transform(F.filter(lines, lambda x: (x["n"] >= first) & (x["n"] <= last)), lambda x: x["n"]))
    return F.size(own) == (last - first + 1)


def quoted(lines: Column, quote: Column, first: Column, last: Column) -> Column:
    """Whether the quote is in the lines of the range (of the block, without one), as it is or with white space compacted."""
    own = F.when(first.isNull(), lines).otherwise(F.filter(lines, lambda x: (x["n"] >= first) & (x["n"] <= last)))
    body = F.array_join(F.transform(own, lambda x: x["text"]), "\n")
    return let(body, lambda b: F.contains(b, quote) | F.contains(exprs.compact_whitespace(b), exprs.compact_whitespace(quote)))


def evidence_issues(v: Column, allowed: Column, blocks: Column, path: list) -> Column:
    """Issues of one piece of evidence. A wrong range also counts as a quote that isn't there."""

    def of(code: str) -> Column:
        return F.array(issue(_P + code, *path))

    def some(bad: Column, code: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), of(code)).otherwise(no_issues())

    def checks(x: Column) -> Column:
        p, quote, r, block = x["p"], x["quote"], x["range"], x["block"]
        found = block.isNotNull()
        ranged = (
            F.when(r["error"].isNotNull(), F.array(issue(F.concat(F.lit(_P), r["error"]), *path)))
            .when(r["first"].isNull() & quote.isNull(), of("needs-range-or-quote"))
            .when(found & r["first"].isNotNull() & ~shown(block["lines"], r["first"], r["last"]), of("range-outside-files-section"))
            .otherwise(no_issues())
        )
        cited = some(found & quote.isNotNull() & (r["error"].isNotNull() | ~quoted(block["lines"], quote, r["first"], r["last"])), "quote-outside-files-section")
        return F.concat(some(~exprs.safe_relative_path(p), "path-escapes-root"), some(~F.array_contains(allowed, p), "path-not-allowed"), some(~found, "path-not-in-files-section"), ranged, cited)

    def with_block(p: Column) -> Column:
        own = F.filter(blocks, lambda b: exprs.normalize_path(b["path"]) == p)
        quote = let(text(field(v, "quote")), lambda q: F.when(~exprs.blank(q), q))
        known = F.struct(p.alias("p"), quote.alias("quote"), line_range(v).alias("range"), F.get(F.slice(own, -1, 1), F.lit(0)).alias("block"))
        return F.when(p.isNull(), of("invalid-path-type")).otherwise(let(known, checks))

    return F.when(kind(v) != "object", of("not-object")).otherwise(let(exprs.normalize_path(text(field(v, "path"))), with_block))


def review_evidence(output: Column, allowed: Column, blocks: Column) -> Column:
    """Issues of all findings' evidence; a finding without any has `missing`. None if there is no findings array."""

    def finding(f: Column, i: Column) -> Column:
        every = items(field(f, "evidence"))
        own = F.flatten(F.transform(every, lambda e, j: evidence_issues(e, allowed, blocks, [F.lit("findings"), i, F.lit("evidence"), j])))
        return F.when(F.size(every) == 0, F.array(issue(_P + "missing", F.lit("findings"), i))).otherwise(own)

    return F.flatten(F.transform(items(field(output, "findings")), finding))


def valid_items(count: Column, issues: Column, group: str) -> Column:
    """Indexes from 0 of items without an issue on the path [group, index, …]."""
    bad = F.transform(F.filter(issues, lambda x: F.get(x["path"], F.lit(0)) == group), lambda x: F.get(x["path"], F.lit(1)).cast("int"))
    every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_except(every, bad)
