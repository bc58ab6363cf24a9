"""Every registered query runs, and agrees with its SQL on DuckDB where it has some."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import difference, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_agrees_with_sql(spark, connection, name):
    problem, _ = difference(spark, connection, name, SF, queries(), oracle_sql())
    assert problem is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["date", "revenue", "orders"] and df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
