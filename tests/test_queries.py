"""Every registered query against its SQL twin (TEST_SF_DIR chooses the scale)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402
import __spark_entry__ as entry_module  # noqa: E402
from watchfold.plans.catalog import QUERIES  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = {"b6_large_spaces": "/root/testdata/sf0.01"}  # no space is large in the smallest tables


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_equals_sql(spark, con, name):
    folder = LARGER.get(name, FOLDER)
    con = oracle.connect(folder) if folder != FOLDER else con
    assert oracle.compare(QUERIES[name].plan(spark, folder), QUERIES[name].sql, con) == []


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_gives_rows(spark, name):
    assert QUERIES[name].plan(spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
