from __future__ import annotations

import pathlib

import pytest

import __spark_entry__ as registered

from .oracle_check import connect, differences, type_differences

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_entry(spark):
    assert registered.entry(spark).columns == ["rank", "value", "count"]


def test_every_query_has_its_sql():
    assert set(registered.LOG_QUERIES) == set(registered.LOG_ORACLE)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_its_sql(spark, connection, name):
    result = registered.queries()[name](spark, SF_DIR)
    sql = registered.oracle_sql()[name]
    assert differences(result, connection, sql) is None
    assert type_differences(result, connection, sql) == ""
