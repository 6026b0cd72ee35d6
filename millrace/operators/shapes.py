"""Schema rules of the three operations' outputs, as arrays of issues over VARIANT. No user-defined functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.constants import CATEGORIES, CONFIDENCES, FEATURE_KEYS, FEATURE_KINDS, FINDING_KEYS, OUTCOMES, SEVERITIES, TRUST_BOUNDARIES
from millrace.functions import exprs
from millrace.functions.exprs import let
from millrace.functions.variants import SQL_NUMBER, SQL_STRING, checked, issue, items, listed, members, no_issues, text, unknown_keys, when

Path = list
Rule = tuple[str, str, str]


# Rules of one field each, as SQL over the struct {m} that members() gave, so that an object is read once for all of them:
# what has to hold, the issue's code, and the field as last step of its path.


def _rule(ok: str, name: str) -> Rule:
    return ok, f"schema.invalid-{name}", name


def _in(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def string(name: str) -> Rule:
    return _rule(SQL_STRING.format(f"{{m}}.{name}"), name)


def optional_string(name: str) -> Rule:
    """A string or null; missing is wrong."""
    return _rule(f"is_variant_null({{m}}.{name}) OR {SQL_STRING.format(f'{{m}}.{name}')}", name)


def choice(name: str, allowed: list[str]) -> Rule:
    return _rule(f"{SQL_STRING.format(f'{{m}}.{name}')} AND try_variant_get({{m}}.{name}, '$', 'string') IN ({_in(allowed)})", name)


def _string_array(name: str) -> str:
    return f"forall(try_variant_get({{m}}.{name}, '$', 'array<variant>'), x -> coalesce({SQL_STRING.format('x')}, false))"


def _array(name: str) -> str:
    return f"try_variant_get({{m}}.{name}, '$', 'array<variant>') IS NOT NULL"


def _counts(name: str) -> str:
    n = SQL_NUMBER.format(f"{{m}}.{name}")
    return f"({n} >= 0 AND {n} = floor({n}))"


def line(name: str) -> Rule:
    """Null, or a whole number from 0."""
    return _rule(f"is_variant_null({{m}}.{name}) OR {_counts(name)}", name)


def count(name: str) -> Rule:
    return _rule(f"{{m}}.{name} IS NULL OR {_counts(name)}", name)


def each(m: Column, name: str, rule, path: Path) -> Column:
    """The rule's issues of every value of an array field."""
    return F.flatten(F.transform(items(m[name]), lambda x, i: rule(x, [*path, F.lit(name), i])))


def object_shape(v: Column, names: list[str], other: Column, fields) -> Column:
    """fields(members) for an object, else the one issue."""
    return let(members(v, names), lambda m: F.when(m.isNull(), F.array(other)).otherwise(fields(m)))


EVIDENCE_KEYS = ["path", "startLine", "endLine", "symbol", "quote"]


def evidence_shape(v: Column, path: Path) -> Column:
    rules = [string("path"), line("startLine"), line("endLine"), optional_string("symbol"), optional_string("quote")]
    return object_shape(v, EVIDENCE_KEYS, issue("schema.evidence-not-object", *path), lambda m: F.concat(unknown_keys(v, EVIDENCE_KEYS, *path), checked(m, path, *rules)))


def finding_shape(v: Column, path: Path) -> Column:
    rules = [
        *[string(n) for n in ("title", "reasoning", "recommendation", "whyTestsDoNotAlreadyCoverThis", "minimumFixScope")],
        choice("category", CATEGORIES),
        choice("severity", SEVERITIES),
        choice("confidence", CONFIDENCES),
        *[optional_string(n) for n in ("reproduction", "suggestedRegressionTest")],
        (_array("evidence"), "schema.invalid-evidence-array", "evidence"),
    ]
    return object_shape(v, FINDING_KEYS, issue("schema.finding-not-object", *path), lambda m: F.concat(unknown_keys(v, FINDING_KEYS, *path), checked(m, path, *rules), each(m, "evidence", evidence_shape, path)))


def review_shape(v: Column) -> Column:
    own = ["files", "symbols", "notes"]

    def inspected(x: Column) -> Column:
        rules = [(_string_array(n), f"schema.invalid-inspected-{n}", n) for n in own]
        return object_shape(x, own, issue("schema.missing-inspected-object", "inspected"), lambda m: F.concat(unknown_keys(x, own, "inspected"), checked(m, ["inspected"], *rules)))

    def fields(m: Column) -> Column:
        found = checked(m, [], (_array("findings"), "schema.missing-findings-array", "findings"))
        return F.concat(unknown_keys(v, ["findings", "inspected"]), found, inspected(m["inspected"]), each(m, "findings", finding_shape, []))

    return object_shape(v, ["findings", "inspected"], issue("review output is not an object"), fields)


def inventory_path(v: Column, inventory: Column, path: Path) -> Column:
    """A path (VARIANT) must stay below the root, and be known if there is an inventory."""
    outside = F.array(issue("map.path-escapes-root", *path, F.lit("path")))
    absent = F.array(issue("map.path-not-in-inventory", *path, F.lit("path")))

    def of(p: Column) -> Column:
        return F.when(p.isNull(), no_issues()).when(~exprs.safe_relative_path(p), outside).when((F.size(inventory) > 0) & ~F.array_contains(inventory, p), absent).otherwise(no_issues())

    return let(exprs.normalize_path(text(v)), of)


def _reference(keys: list[str], texts: list[str], optional: list[str], code: str, inventory: Column):
    def rule(v: Column, path: Path) -> Column:
        rules = [*map(string, texts), *map(optional_string, optional)]
        return object_shape(v, keys, issue(code, *path), lambda m: F.concat(unknown_keys(v, keys, *path), checked(m, path, *rules), inventory_path(m["path"], inventory, path)))

    return rule


def feature_shape(inventory: Column):
    entry = _reference(["path", "symbol", "route", "command"], ["path"], ["symbol", "route", "command"], "schema.entrypoint-not-object", inventory)
    file = _reference(["path", "reason"], ["path", "reason"], [], "schema.file-ref-not-object", inventory)
    test = _reference(["path", "command"], ["path"], ["command"], "schema.test-ref-not-object", inventory)

    def boundary(x: Column, path: Path) -> Column:
        return listed(when(~F.coalesce(text(x).isin(TRUST_BOUNDARIES), F.lit(False)), "schema.invalid-trustBoundary", *path))

    def rule(v: Column, path: Path) -> Column:
        first = [string("title"), string("summary"), choice("kind", FEATURE_KINDS), choice("confidence", CONFIDENCES), *[_rule(_array(n), n) for n in ("entrypoints", "ownedFiles", "contextFiles", "tests")]]

        def fields(m: Column) -> Column:
            return F.concat(
                unknown_keys(v, FEATURE_KEYS, *path),
                checked(m, path, *first),
                each(m, "entrypoints", entry, path),
                each(m, "ownedFiles", file, path),
                each(m, "contextFiles", file, path),
                each(m, "tests", test, path),
                checked(m, path, _rule(_string_array("tags"), "tags"), _rule(_array("trustBoundaries"), "trustBoundaries")),
                each(m, "trustBoundaries", boundary, path),
                checked(m, path, _rule(f"{{m}}.reason IS NULL OR {SQL_STRING.format('{m}.reason')}", "reason")),
            )

        return object_shape(v, FEATURE_KEYS, issue("schema.feature-not-object", *path), fields)

    return rule


def map_shape(v: Column, inventory: Column) -> Column:
    keys = ["features", "notes", "created", "changed", "stale"]
    rules = [(_array("features"), "schema.missing-features-array", "features"), _rule(f"{{m}}.notes IS NULL OR {_string_array('notes')}", "notes"), *map(count, ("created", "changed", "stale"))]
    return object_shape(v, keys, issue("map output is not an object"), lambda m: F.concat(unknown_keys(v, keys), checked(m, [], *rules), each(m, "features", feature_shape(inventory), [])))


def revalidate_shape(v: Column) -> Column:
    keys = ["outcome", "reasoning", "commands"]
    rules = [choice("outcome", OUTCOMES), string("reasoning"), _rule(_string_array("commands"), "commands")]
    return object_shape(v, keys, issue("revalidate output is not an object"), lambda m: F.concat(unknown_keys(v, keys), checked(m, [], *rules)))
