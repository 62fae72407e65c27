"""Every query against its SQL twin on the smallest tables; those without one must run."""

import os

import pytest

import __spark_entry__
from tests.compare import DIRECTORY, connection, rows_of_spark, rows_of_sql
from tickloom.plans import audit, market, quality, replay, trading

PLANS = (quality, market, trading, replay, audit)
QUERIES = {name: q for p in PLANS for name, q in p.QUERIES.items()}
SQL = {name: s for p in PLANS for name, s in p.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="the test tables are not there")


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIRECTORY)
    if name in SQL:
        assert rows_of_spark(df) == rows_of_sql(duck, SQL[name])
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    assert set(SQL) <= set(QUERIES) and set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
