"""Every registered query against its SQL on the smallest tables."""

import pytest

from conftest import same_as_sql
from millrace.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir, duck):
    same_as_sql(catalogue.QUERIES[name](spark, sf_dir), duck, catalogue.SQL[name])


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_llm():
    from conftest import ROOT

    for path in (ROOT / "millrace").rglob("*.py"):
        if "llm" not in path.parts:
            assert "millrace.llm" not in path.read_text(), path
