"""Every registered query of the engine against its SQL; those without SQL have to run."""

import pytest

from skerry import catalog
from tests.compare import duck_rows, spark_rows

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(sf_dir, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    rows = found.collect()
    assert rows and all(len(r) == len(found.columns) for r in rows)


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
