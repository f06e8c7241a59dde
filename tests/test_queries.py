"""Every registered query runs; where it has a SQL twin the whole results are equal."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare
from tests.conftest import SF

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
MAY_BE_EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    assert df.limit(1).count() == 1


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
