"""Every registered query runs on the small tables; those with SQL give the same rows as DuckDB."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "scripts")]

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
from barloom import plans  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, con, name):
    ok, note = compare.compare(name, spark, con, SF)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_checks_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
