"""Sections of prompts: file blocks, numbered lines, path lists, JSON sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.constants import CONTEXT_MARK, FINDING_MARK, INVENTORY_MARK, PATH_PREFIXES, PATHS_MARK, SHAPE_MARK
from millrace.functions import exprs, variants
from millrace.functions.exprs import let

_HEADER = r"(?m)(?=^--- .+? \(.+?\)\n)"
_HEAD_LINE = r"^--- (.+?) \((.+?)\)\z"


def section(prompt: Column, start: str, end: str | None = None) -> Column:
    """Text after the first start mark, up to the next end mark (null if either is absent)."""

    def cut(tail: Column) -> Column:
        return tail if end is None else F.when(F.contains(tail, F.lit(end)), F.substring_index(tail, end, 1))

    at = F.locate(start, prompt)
    return F.when(at > 0, let(F.substring(prompt, at + len(start), F.length(prompt)), cut))


def raw_lines(body: Column) -> Column:
    """array<string> of lines like `12 | text`."""
    # no line end of any kind may follow, where $ would allow one
    return F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"^\d+ \| ?.*\z"))


def line_number(raw: Column) -> Column:
    """Of a numbered line; null beyond the integers."""
    return F.substring_index(raw, " |", 1).try_cast("int")


def numbered_lines(body: Column) -> Column:
    """array<struct<n, text, raw>> of lines like `12 | text`."""
    return F.transform(raw_lines(body), lambda x: F.struct(line_number(x).alias("n"), F.regexp_extract(x, r"^\d+ \| ?(.*)\z", 1).alias("text"), x.alias("raw")))


def file_blocks(text: Column, lines=numbered_lines) -> Column:
    """array<struct<path, descriptor, body, lines>> of the `--- path (descriptor)` blocks; a body ends at the next header. lines: what to make of a body's lines."""
    cut = F.transform(F.split(text, _HEADER, -1), lambda p: F.struct(F.substring_index(p, "\n", 1).alias("head"), p.alias("all")))
    # the header is a whole line, so that a part's other lines needn't be looked at for it
    parts = F.filter(cut, lambda p: p["head"].rlike(_HEAD_LINE) & F.contains(p["all"], F.lit("\n")))

    def block(p: Column) -> Column:
        path, descriptor = (F.regexp_extract(p["head"], _HEAD_LINE, i) for i in (1, 2))
        body = exprs.rest_from(p["all"], F.length(p["head"]) + 2)
        return let(body, lambda b: F.struct(path.alias("path"), descriptor.alias("descriptor"), b.alias("body"), lines(b).alias("lines")))

    return F.transform(F.coalesce(parts, F.array().cast("array<struct<head:string,all:string>>")), block)


def listed(text: Column, mark: str = PATHS_MARK, bullet: str = "- ") -> Column:
    """Items of the list right after the mark; the first other line ends it."""

    def take(lines: Column) -> Column:
        ends = F.filter(F.transform(lines, lambda x, i: F.when(~x.startswith(bullet), i)), lambda i: i.isNotNull())
        own = F.slice(lines, 1, F.coalesce(F.array_min(ends), F.size(lines)))
        return F.transform(own, lambda x: F.substring(x, F.lit(len(bullet) + 1), F.length(x)))

    return F.coalesce(let(F.split(section(text, mark), "\n", -1), take), F.array().cast("array<string>"))


def json_section(prompt: Column, start: str, end: str | None = None) -> Column:
    return variants.parse_strict(section(prompt, start, end))


def prompt_context(prompt: Column) -> Column:
    return json_section(prompt, CONTEXT_MARK, "\n" + SHAPE_MARK)


def finding_context(prompt: Column) -> Column:
    return json_section(prompt, FINDING_MARK)


def finding_paths(prompt: Column) -> Column:
    """Distinct normalized paths of the evidence in the prompt's finding, sorted."""
    evidence = variants.items(variants.field(finding_context(prompt), "evidence"))
    paths = F.transform(evidence, lambda e: exprs.normalize_path(variants.text(variants.field(e, "path"))))
    return F.array_sort(F.array_distinct(F.filter(paths, lambda p: p.isNotNull())))


def inventory(prompt: Column) -> Column:
    return json_section(prompt, INVENTORY_MARK, "\n" + SHAPE_MARK)


def walk_strings(value: Column, depth: int = 8) -> Column:
    """All strings in a JSON value, to a depth, one level of containers after the other. Expressions, no recursion at run time."""
    found = F.array().cast("array<string>")
    level = F.array(value)
    for _ in range(depth + 1):
        found = F.concat(found, F.transform(F.filter(level, lambda v: variants.kind(v) == "string"), lambda v: F.try_variant_get(v, "$", "string")))
        level = F.flatten(F.transform(level, children))
    return found


def children(v: Column) -> Column:
    """Values directly inside an object or array."""
    none = F.array().cast("array<variant>")
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), none)


def paths_in(strings: Column) -> Column:
    """Distinct normalized strings that look like repository paths and don't leave the root, sorted."""
    normal = F.transform(strings, exprs.normalize_path)
    return F.array_sort(F.array_distinct(F.filter(normal, lambda p: exprs.path_like(p, PATH_PREFIXES) & exprs.safe_relative_path(p))))


def allowed_paths(explicit: Column, included: Column, blocks: Column) -> Column:
    """The explicit list, else readable included files, else the blocks' own paths."""
    own = F.array_distinct(F.transform(blocks, lambda b: exprs.normalize_path(b["path"])))
    return F.when(F.size(explicit) > 0, F.array_distinct(F.transform(explicit, exprs.normalize_path))).when(F.size(included) > 0, F.array_distinct(F.transform(included, exprs.normalize_path))).otherwise(own)
