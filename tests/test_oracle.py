"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from livetables.registry import core
from tests.check import compare, duck

QUERIES, SQL = core.QUERIES, core.ORACLES     # those of the optional subpackage have their own tests


@pytest.fixture(scope="module")
def con(sf="/root/testdata/sf0.001"):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        assert compare(name, df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
