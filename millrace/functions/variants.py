"""Dynamically typed JSON values as VARIANT: strict parsing, types, fields and issue lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.exprs import let

ISSUE = "struct<code:string,path:array<string>>"
#: Of a VARIANT, as SQL text. Rules over many fields are written as SQL, as each Column operator costs a call to the JVM when a query is built.
SQL_STRING = "schema_of_variant({0}) = 'STRING'"
# objects and arrays have no double; of the other kinds the schema tells
SQL_NUMBER = "CASE WHEN schema_of_variant({0}) NOT IN ('STRING', 'BOOLEAN', 'VOID') THEN try_variant_get({0}, '$', 'double') END"


def let_sql(value: Column, name: str, then: str) -> Column:
    """The SQL text, in which name stands for value, computed once."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"{name} -> {then}")), 1)


def parse_strict(s: Column) -> Column:
    """The value of a JSON text, or SQL NULL. Nothing may follow the value; repeated keys are allowed (session.configure).

    The engine's parser ignores what follows a value. So the text must also be the one element of an array and the
    value of an object's only key.
    """

    def of(t: Column) -> Column:
        one = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        inside = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
        return let(F.try_variant_get(one, "$", "array<variant>"), lambda a: F.when((F.size(a) == 1) & inside.isNotNull(), F.get(a, F.lit(0))))

    return let(s, of)


def is_json(s: Column) -> Column:
    return F.coalesce(parse_strict(s).isNotNull(), F.lit(False))


def kind(v: Column) -> Column:
    """missing, null, object, array, string, number or boolean."""
    named = {"STRING": "string", "VOID": "null", "BOOLEAN": "boolean"}
    cases = "".join(f" WHEN s = '{schema}' THEN '{name}'" for schema, name in named.items())
    return let_sql(F.schema_of_variant(v), "s", f"CASE WHEN s IS NULL THEN 'missing'{cases} WHEN startswith(s, 'OBJECT') THEN 'object' WHEN startswith(s, 'ARRAY') THEN 'array' ELSE 'number' END")


def field(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$['{key}']", "variant")


def members(v: Column, names: list[str]) -> Column:
    """The named fields of an object as one struct of VARIANT, read in one go. Null for what isn't an object; a field that isn't there is null."""
    return F.try_variant_get(v, "$", "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">")


def text(v: Column) -> Column:
    """The string, if the value is one."""
    return let_sql(v, "x", f"CASE WHEN {SQL_STRING.format('x')} THEN try_variant_get(x, '$', 'string') END")


def number(v: Column) -> Column:
    return let_sql(v, "x", SQL_NUMBER.format("x"))


def whole(v: Column) -> Column:
    """The integer, if the value is a number without fraction (1.0 is one)."""
    return let(number(v), lambda n: F.when(n == F.floor(n), n.cast("long")))


def items(v: Column) -> Column:
    """The array's values; none for other kinds."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.expr("CAST(array() AS ARRAY<VARIANT>)"))


def keys(v: Column) -> Column:
    return F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.expr("CAST(array() AS ARRAY<STRING>)"))


def issue(code: Column | str, *path: Column | str) -> Column:
    cells = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in path]
    return F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), (F.array(*cells) if cells else F.array().cast("array<string>")).alias("path"))


def no_issues() -> Column:
    return F.expr(f"CAST(array() AS ARRAY<{ISSUE}>)")


def when(bad: Column, code: Column | str, *path: Column | str) -> Column:
    """An issue, or null."""
    return F.when(bad, issue(code, *path))


def listed(*checks: Column) -> Column:
    """The issues among what when() gave."""
    return F.array_compact(F.array(*checks))


def checked(m: Column, path: list[Column | str], *rules: tuple[str, str, str]) -> Column:
    """Issues of the rules that don't hold: (condition as SQL over m, code, last step of the path, or nothing)."""
    steps = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in path]
    at = F.array(*steps) if steps else F.expr("CAST(array() AS ARRAY<STRING>)")
    cases = [f"CASE WHEN NOT coalesce({ok.replace('{m}', 't.m')}, false) THEN named_struct('code', '{code}', 'path', {f"concat(t.p, array('{step}'))" if step else 't.p'}) END" for ok, code, step in rules]
    return let_sql(F.struct(m.alias("m"), at.alias("p")), "t", f"array_compact(array({', '.join(cases)}))")


def unknown_keys(v: Column, allowed: list[str], *path: Column | str) -> Column:
    """An issue for each key that isn't allowed."""
    names = ", ".join(f"'{a}'" for a in allowed)
    extra = F.call_function("filter", keys(v), F.expr(f"k -> k NOT IN ({names})"))
    return F.transform(extra, lambda k: issue("schema.unknown-key", *path, k))


def key_set(v: Column) -> Column:
    """Sorted keys with commas; the kind's name for what isn't an object."""
    return F.when(kind(v) == "object", F.array_join(F.array_sort(keys(v)), ",")).otherwise(kind(v))
