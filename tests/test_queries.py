"""Every registered query against its SQL twin, value by value."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from flowtide.plans.catalog import QUERIES
from flowtide.plans.oracle import ORACLE
from oracle_check import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE) <= set(oracle_sql()) and set(QUERIES) <= set(queries())


@needs_tables
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert difference(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) is None


@needs_tables
def test_entry(spark):
    assert entry(spark).count() > 0
