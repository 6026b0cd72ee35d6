"""Scalar functions as Column expressions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.constants import OUTCOME_CLASSES, STOP_WORDS


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def unnest(rows: DataFrame, value: Column, name: str, *keep: str) -> DataFrame:
    """A row for each element of an array that isn't null, with the columns in keep.

    For an explode the optimizer infers a filter on the array, and pushes it below to where the array is made: a second
    evaluation of it, with its inputs written out at every use. An outer explode has no such filter.
    """
    return rows.select(*keep, F.explode_outer(value).alias(name)).where(F.col(name).isNotNull())


# lengths and cuts


def utf8_len(s: Column) -> Column:
    return F.octet_length(s)


def utf16_len(s: Column) -> Column:
    """Code units as JavaScript counts them: two for a character beyond U+FFFF."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def exceeds_utf16(s: Column, most: int) -> Column:
    """Whether s has more code units. It has no more than bytes and no fewer than characters; only between these is it encoded."""
    return F.when(F.octet_length(s) <= most, F.lit(False)).when(F.length(s) > most, F.lit(True)).otherwise(utf16_len(s) > most)


def truncate_utf8(s: Column, most: Column | int) -> Column:
    """The longest prefix of whole characters within so many UTF-8 bytes."""
    limit = F.lit(most) if isinstance(most, int) else most
    raw = s.cast("binary")
    cuts = [F.substring(raw, F.lit(1), F.greatest(limit - k, F.lit(0))).cast("string") for k in range(4)]
    # the first that is valid; those after it aren't looked at
    whole = F.coalesce(*[let(cut, lambda c: F.when(F.is_valid_utf8(c), c)) for cut in cuts])
    return F.when(F.octet_length(s) <= limit, s).otherwise(whole)


def place_of(mark: str, s: Column) -> Column:
    """Where the mark first is, in characters from 1; 0 if nowhere, which contains finds faster than locate."""
    return F.when(~F.contains(s, F.lit(mark)), F.lit(0)).otherwise(F.locate(mark, s))


def rest_from(s: Column, start: Column) -> Column:
    """All from a character on."""
    return F.substring(s, start, F.lit(2**31 - 1))


def blank(s: Column) -> Column:
    """Nothing but white space, Unicode's included."""
    return F.length(js_trim(s)) == 0


def js_trim(s: Column) -> Column:
    return F.regexp_replace(s, "(?U)^[\\s\uFEFF]+|[\\s\uFEFF]+$", "")


def compact_whitespace(s: Column) -> Column:
    return js_trim(F.regexp_replace(s, "(?U)[\\s\uFEFF]+", " "))


# hashes and encodings


def stable_hash(s: Column) -> Column:
    return F.substring(F.sha2(s, 256), 1, 16)


def record_key(capture_id: Column, row_json: Column) -> Column:
    """capture:<id>, or hash:<digest of the row's JSON text> without an id."""
    return F.when(F.length(capture_id) > 0, F.concat(F.lit("capture:"), capture_id)).otherwise(F.concat(F.lit("hash:"), F.sha2(row_json, 256)))


def base64_text(s: Column) -> Column:
    return F.base64(s.cast("binary"))


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


# paths


def normalize_path(p: Column) -> Column:
    return F.regexp_replace(F.translate(p, "\\", "/"), "^\\./+", "")


def safe_relative_path(p: Column) -> Column:
    """Not empty, not absolute, not starting with ../ (`..` alone and inner ../ pass)."""
    return (F.length(p) > 0) & ~p.startswith("../") & ~p.startswith("/")


def path_like(p: Column, prefixes: list[str]) -> Column:
    known = F.lit(False)
    for prefix in prefixes:
        known = known | p.startswith(prefix)
    return F.contains(p, F.lit("/")) | p.startswith(".") | p.rlike(r"(?i)\.[a-z0-9]+$") | known


# numbers


def round_metric(x: Column) -> Column:
    return F.round(x.cast("double"), 6)


def ratio(a: Column, b: Column) -> Column:
    """0 for a zero denominator."""
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), 6), F.lit(0.0))


def ratio_or_null(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(F.round(2 * precision * recall / (precision + recall), 6))


def nullable_delta(a: Column, b: Column) -> Column:
    return round_metric(a - b)


def bounded_gap(total: Column, covered: Column) -> Column:
    return F.greatest(F.lit(0), total - covered)


def ceil_divide(a: Column, b: Column) -> Column:
    return F.when((a <= 0) | (b <= 0), F.lit(0)).otherwise(F.ceil(a / b)).cast("long")


def distribute_evenly(total: Column, parts: Column) -> Column:
    """Least and most of each part when a total is dealt out."""
    low = F.when(parts > 0, F.floor(total / parts)).otherwise(0)
    return F.struct(low.cast("long").alias("min"), (low + F.when((parts > 0) & (total % parts > 0), 1).otherwise(0)).cast("long").alias("max"))


def number_or_zero(x: Column) -> Column:
    return F.coalesce(F.when(F.isnan(x.cast("double")), None).otherwise(x), F.lit(0))


def non_negative_integer(x: Column, default: Column) -> Column:
    return F.when((x >= 0) & (x == F.floor(x)), x).otherwise(default)


def meets(actual: Column, threshold: Column | float) -> Column:
    return actual.isNotNull() & (actual >= threshold)


# labels


def safe_label(s: Column, default: str = "unknown") -> Column:
    return F.coalesce(F.when(s != "", s), F.lit(default))


def one_of(s: Column, allowed: list[str], default: str = "unknown") -> Column:
    return F.when(s.isin(allowed), s).otherwise(F.lit(default))


def first_id(*names: Column, ordinal: Column) -> Column:
    """The first name that isn't empty, else row-<ordinal>."""
    return F.coalesce(*[F.when(n != "", n) for n in names], F.concat(F.lit("row-"), ordinal.cast("string")))


def outcome_class(outcome: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, members in OUTCOME_CLASSES.items():
        out = F.when(outcome.isin(members), F.lit(name)).otherwise(out)
    return out


def redact_argument(argument: Column, key_name: str) -> Column:
    return F.when(F.contains(argument, F.lit(key_name)), F.lit("<redacted>")).otherwise(argument)


# sets


def title_tokens(title: Column) -> Column:
    words = F.filter(F.split(F.lower(title), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOP_WORDS]))


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_distinct(a)) == F.size(F.array_distinct(b))) & (F.size(F.array_except(a, b)) == 0)


# text with JSON in it


def first_json_object(s: Column) -> Column:
    """From the first { to the last }, or null."""
    start, end = F.locate("{", s), F.length(s) - F.locate("}", F.reverse(s)) + 1
    found = (start > 0) & (F.locate("}", s) > 0) & (end >= start)
    return F.when(found, F.substring(s, start, end - start + 1))


def mask_labels(ids: Column, prompt_len: Column, ignore: int = -100) -> Column:
    """Labels for a loss over the answer: the prompt's are ignored, but for the last if nothing else is left."""
    masked = F.transform(ids, lambda x, i: F.when(i < prompt_len, F.lit(ignore).cast("long")).otherwise(x.cast("long")))
    every = F.forall(masked, lambda x: x == ignore) & (F.size(ids) > 0)
    return F.when(every, F.transform(ids, lambda x, i: F.when(i < F.size(ids) - 1, F.lit(ignore).cast("long")).otherwise(x.cast("long")))).otherwise(masked)


def ranges_of(numbers: Column) -> Column:
    """Maximal runs of consecutive integers of an array, as array of struct<first, last>."""
    ordered = F.array_sort(F.array_distinct(numbers))
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grow = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["last"] == x - 1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["first"].alias("first"), x.cast("int").alias("last"))))
        return F.when(grow, longer).otherwise(F.concat(acc, F.array(F.struct(x.cast("int").alias("first"), x.cast("int").alias("last")))))

    return F.aggregate(ordered, empty, step)
