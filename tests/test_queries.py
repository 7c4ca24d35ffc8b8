"""Every registered query with SQL gives what DuckDB gives; every other one gives rows and a stable schema."""

from __future__ import annotations

import pytest

from tests.compare import of_duck, of_spark
from weftline import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf_dir, duck):
    names, rows = of_spark(QUERIES[name](spark, sf_dir))
    expected_names, expected = of_duck(duck, SQL[name])
    assert names == expected_names
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.schema == QUERIES[name](spark, sf_dir).schema
    assert df.count() >= 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
