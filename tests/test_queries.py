"""Every registered query with a SQL counterpart agrees with DuckDB on the smallest tables."""

import os

import pytest

import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

from .compare import compare, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    assert compare(entry.queries()[name](spark, FOLDER), con, ORACLE[name]) is None


def test_entry_runs(spark):
    if os.path.isdir(FOLDER):
        assert entry.entry(spark).count() > 0
