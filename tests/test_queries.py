"""Every registered query on the smallest tables, against its SQL twin where there is one."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_twins_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 1000


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    result = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF_DIR)
    assert not result.startswith("FAIL"), result
    assert "rows=0 " not in result
