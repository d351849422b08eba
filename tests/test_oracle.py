"""Every registered query against its SQL, at the size the correctness gate uses."""

import pytest

import __spark_entry__ as entry
import compare
from standins import registered

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(registered()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registered()))
def test_matches_sql(spark, con, name):
    found = entry.queries()[name](spark, FOLDER)
    assert compare.differences(found, con, entry.oracle_sql()[name]) == []


def test_entry(spark):
    assert not entry.entry(spark).isEmpty()
