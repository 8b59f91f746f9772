"""Every registered query at the smallest scale, against its SQL where it has one."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_is_callable_and_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 80


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, FOLDER, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_entry(spark):
    assert {r.part for r in entry.entry(spark).collect()} == {"train", "val", "test", "dropped"}
