"""Every query against its SQL on the smallest tables."""

import pytest
from oracle import connect, difference

import __spark_entry__ as target

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_names_agree():
    assert set(target.oracle_sql()) <= set(target.queries())


def test_entry(spark):
    assert target.entry(spark).columns


@pytest.mark.parametrize("name", sorted(target.queries()))
def test_query(spark, duck, name):
    result = target.queries()[name](spark, SF_DIR)
    sql = target.oracle_sql().get(name)
    if sql is None:
        assert result.collect() is not None
    else:
        assert difference(result, sql, duck) is None
