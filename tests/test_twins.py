"""Every registered query against its SQL twin on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from tests.twins import connect, differences

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, TWINS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_agrees_with_its_twin(spark, con, name):
    assert differences(spark, con, FOLDER, QUERIES[name], TWINS[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_query_without_twin_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["id", "structured_title", "structured_description"]
