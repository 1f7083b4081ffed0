"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

import tools_parity
from rankforge.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, small, name):
    said, ok, _ = tools_parity.compare(spark, small, name)
    assert ok, said


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"r_cell_recall", "m_posterior"}))
def test_runs(spark, small, name):
    assert registry.queries()[name](spark, small).count() >= 0


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert duckdb.__version__
