"""Bounding long prompts while keeping the lines around the evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.constants import CLEAN_LINES, FILES_MARK, NOTE_MIDDLE, NOTE_TRAILING, NOTE_TRUNCATED, SHAPE_MARK, WINDOW_BYTES, WINDOW_RADIUS
from millrace.functions import exprs, variants
from millrace.functions.exprs import let
from millrace.operators import prompt


def clamp_prelude(s: Column, budget: Column | int) -> Column:
    """Within a budget of characters (but for the note): the head alone, or head and tail around the JSON shape."""

    def cut(most: Column, length: Column) -> Column:
        head = F.greatest(F.lit(1000), F.floor(most * 55 / 100).cast("int"))
        tail = F.greatest(F.lit(1000), most - head)

        def around(shape: Column) -> Column:
            both = F.concat(F.substring(s, F.lit(1), head), F.lit(NOTE_MIDDLE), exprs.rest_from(s, F.greatest(shape, length - tail + 1)))
            return F.when(shape == 0, F.concat(F.substring(s, F.lit(1), most), F.lit(NOTE_TRUNCATED))).otherwise(both)

        return F.when(length <= most, s).otherwise(let(exprs.place_of(SHAPE_MARK, s), around))

    return let(F.lit(budget) if isinstance(budget, int) else budget, lambda most: let(F.length(s), lambda length: cut(most, length)))


def split_files(s: Column) -> Column:
    """struct<prelude, files>: the mark stays in the prelude; files is null without one."""

    def of(at: Column) -> Column:
        end = at + len(FILES_MARK) - 1
        return F.struct(F.when(at > 0, F.substring(s, F.lit(1), end)).otherwise(s).alias("prelude"), F.when(at > 0, exprs.rest_from(s, end + 1)).alias("files"))

    return let(exprs.place_of(FILES_MARK, s), of)


def evidence_list(output: Column) -> Column:
    """array<struct<path, first, last>> of a review's evidence with a path; lines default to 1 and to the first."""

    def one(e: Column) -> Column:
        first = F.coalesce(variants.whole(variants.field(e, "startLine")), F.lit(1))
        return F.struct(variants.text(variants.field(e, "path")).alias("path"), first.alias("first"), F.coalesce(variants.whole(variants.field(e, "endLine")), first).alias("last"))

    every = F.flatten(F.transform(variants.items(variants.field(output, "findings")), lambda f: variants.items(variants.field(f, "evidence"))))
    return F.filter(F.transform(every, one), lambda e: e["path"].isNotNull())


def slice_text(block: Column, low: Column, high: Column) -> Column:
    """The block's header and its raw lines from low to high; empty if none."""
    head = F.concat(F.lit("--- "), block["path"], F.lit(" ("), block["descriptor"], F.lit(")\n"))
    own = F.filter(block["lines"], lambda x: (x["n"] >= low) & (x["n"] <= high))
    return let(own, lambda found: F.when(F.size(found) > 0, F.concat(head, F.array_join(F.transform(found, lambda x: x["raw"]), "\n"))).otherwise(""))


def evidence_snippets(blocks: Column, evidence: Column, radius: int = WINDOW_RADIUS) -> Column:
    """Lines around each piece of evidence, in its first block of that exact path; equal ranges of lines once."""

    def around(e: Column) -> Column:
        return F.struct(e["path"].alias("path"), F.greatest(F.lit(1), e["first"] - radius).alias("low"), (F.greatest(e["last"], e["first"]) + radius).alias("high"))

    def snippet(e: Column) -> Column:
        first = F.get(F.filter(blocks, lambda b: b["path"] == e["path"]), F.lit(0))
        return let(first, lambda block: F.when(block.isNotNull(), slice_text(block, e["low"], e["high"])).otherwise(""))

    return F.filter(F.transform(F.array_distinct(F.transform(evidence, around)), snippet), lambda s: s != "")


def head_snippets(blocks: Column, lines: int = CLEAN_LINES) -> Column:
    """The first lines of all blocks together, up to a total."""
    start = F.struct(F.lit(lines).alias("left"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        def add(own: Column) -> Column:
            head = F.concat(F.lit("--- "), b["path"], F.lit(" ("), b["descriptor"], F.lit(")\n"), F.array_join(F.transform(own, lambda x: x["raw"]), "\n"))
            return F.struct((acc["left"] - F.size(own)).alias("left"), F.when(F.size(own) > 0, F.concat(acc["out"], F.array(head))).otherwise(acc["out"]).alias("out"))

        return let(F.slice(b["lines"], 1, F.greatest(acc["left"], F.lit(0))), add)

    return F.aggregate(blocks, start, step)["out"]


def _with_lines(blocks: Column, lines) -> Column:
    return F.transform(blocks, lambda b: F.struct(b["path"].alias("path"), b["descriptor"].alias("descriptor"), lines(b["lines"]).alias("lines")))


def window_prompt(text: Column, evidence: Column, budget: int = WINDOW_BYTES) -> Column:
    """struct<prompt, windowed, strategy, omitted, blocks> of bounded_prompt."""

    def out(w: Column) -> Column:
        return F.struct(w["prompt"].alias("prompt"), w["windowed"].alias("windowed"), w["strategy"].alias("strategy"), omitted_units(text, w).alias("omitted"), w["blocks"].alias("blocks"))

    return let(bounded_prompt(text, evidence, budget), out)


def omitted_units(text: Column, window: Column) -> Column:
    """UTF-16 units by which the text is longer than its window (of bounded_prompt)."""
    return F.when(window["blocks"] < 0, F.lit(0)).otherwise(F.greatest(F.lit(0), exprs.utf16_len(text) - exprs.utf16_len(window["prompt"])))


def bounded_prompt(text: Column, evidence: Column, budget: int = WINDOW_BYTES) -> Column:
    """struct<prompt, windowed, strategy, blocks>. Gate and slices count UTF-16 units and characters, the cap UTF-8 bytes. A null text stays.

    Each step's value has a name: written out at every use, blocks would be made again for each piece of evidence. Short texts have none of it.
    """
    short = F.struct(text.alias("prompt"), F.lit(False).alias("windowed"), F.lit("unchanged").alias("strategy"), F.lit(-1).alias("blocks"))

    def bounded(cut: Column, windowed, strategy: Column, blocks: Column) -> Column:
        def out(p: Column) -> Column:
            return F.struct(p.alias("prompt"), windowed(p).alias("windowed"), strategy.alias("strategy"), blocks.alias("blocks"))

        return let(cut, lambda c: let(exprs.truncate_utf8(c, budget), out))

    def centered(parts: Column, blocks: Column, items: Column) -> Column:
        def joined(snippets: Column) -> Column:
            files = F.when(F.size(snippets) > 0, F.concat(F.array_join(snippets, "\n\n"), F.lit("\n"))).otherwise("")
            # files take nothing away from a budget that isn't above the least
            left = (lambda f: F.greatest(F.lit(4000), budget - exprs.utf16_len(f))) if budget > 4000 else (lambda f: F.lit(4000))
            whole = let(files, lambda f: F.concat(clamp_prelude(parts["prelude"], left(f)), f))
            note = len(NOTE_TRAILING.encode())
            cut = let(whole, lambda j: F.when(exprs.exceeds_utf16(j, budget), F.concat(exprs.truncate_utf8(j, max(0, budget - note)), F.lit(NOTE_TRAILING))).otherwise(j))
            strategy = F.when(F.size(items) > 0, "evidence-centered-file-window").otherwise("clean-review-head-file-window")
            return bounded(cut, lambda p: F.lit(True), strategy, F.size(snippets))

        numbered = _with_lines(blocks, lambda lines: F.transform(lines, lambda x: F.struct(prompt.line_number(x).alias("n"), x.alias("raw"))))
        first = _with_lines(blocks, lambda lines: F.transform(F.slice(lines, 1, CLEAN_LINES), lambda x: F.struct(x.alias("raw"))))
        around = let(numbered, lambda b: evidence_snippets(b, items))
        return let(F.when(F.size(items) > 0, around).otherwise(head_snippets(first)), joined)

    plain = bounded(clamp_prelude(text, budget), lambda p: p != text, F.lit("prompt-clamp-no-files-section"), F.lit(0))

    def with_blocks(parts: Column, blocks: Column) -> Column:
        return F.when(F.size(blocks) == 0, plain).otherwise(let(evidence, lambda items: centered(parts, blocks, items)))

    long = let(split_files(text), lambda parts: let(prompt.file_blocks(parts["files"], prompt.raw_lines), lambda blocks: with_blocks(parts, blocks)))
    return F.when(text.isNull() | ~exprs.exceeds_utf16(text, budget), short).otherwise(long)


def window_rows(rows: DataFrame, budget: int = WINDOW_BYTES) -> DataFrame:
    """Chat rows with bounded prompts and six more metadata fields; messages are the first three. The last one's output says where the evidence lies."""
    output = variants.parse_strict(F.element_at("messages", -1)["content"])
    found = rows.withColumn("_w", bounded_prompt(F.get("messages", F.lit(1))["content"], evidence_list(output), budget))
    user = F.struct(F.get("messages", F.lit(1))["role"].alias("role"), F.col("_w.prompt").alias("content"))
    meta = F.col("metadata")
    for name, value in (
        ("windowed", F.col("_w.windowed")),
        ("windowStrategy", F.col("_w.strategy")),
        ("originalPromptBytes", F.coalesce(F.col("metadata.promptBytes"), exprs.utf8_len(F.get("messages", F.lit(1))["content"]))),
        ("windowPromptBytes", exprs.utf8_len(F.col("_w.prompt"))),
        ("omittedPromptChars", omitted_units(F.get("messages", F.lit(1))["content"], F.col("_w"))),
        ("retainedFileBlocks", F.col("_w.blocks")),
    ):
        meta = meta.withField(name, value)
    rest = [c for c in rows.columns if c not in ("messages", "metadata")]
    return found.select(F.array(F.get("messages", F.lit(0)), user, F.get("messages", F.lit(2))).alias("messages"), meta.alias("metadata"), *rest)


def window_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, windowed rows and the longest prompt in bytes (0 for none), by key columns. rows: windowed, bytes."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if("windowed").alias("windowed_rows"), F.coalesce(F.max("bytes"), F.lit(0)).alias("max_bytes"))
