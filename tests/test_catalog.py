"""Every core query that SQL can express, against DuckDB on the smallest tables."""

import oracle
import pytest

from siltstone.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, tiny, name):
    oracle.same(spark, tiny, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, tiny, name):
    df = catalog.QUERIES[name](spark, tiny)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
