"""Every registered query against its SQL, and the driver contract."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_module
from tidebook.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    assert name in ORACLES
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) is None


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() == 5
    assert df.columns == ["symbol", "sharpe", "total_return", "max_drawdown"]


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) <= set(entry_module.queries())


def test_quarantined_values_without_a_price(spark, tmp_path):
    """A missing price is no value to judge, in SQL as here."""
    rows = "SELECT * REPLACE (CASE WHEN l_orderkey % 2 = 0 THEN l_extendedprice END AS l_extendedprice) FROM lineitem"
    connect(SF).execute(f"COPY ({rows}) TO '{tmp_path}/lineitem.parquet'")
    name = "quarantined_values"
    assert compare(spark, connect(str(tmp_path)), QUERIES[name], ORACLES[name], str(tmp_path)) is None
