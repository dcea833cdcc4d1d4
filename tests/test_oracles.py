"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    n, message = compare(spark, con, SF, name, entry.queries(), entry.oracle_sql())
    assert not message, message
    assert n >= 0


def test_entry(spark):
    assert entry.entry(spark).columns
