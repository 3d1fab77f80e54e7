"""Every registered query beside its SQL oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from checks.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
# The corpus queries have tests of their own; this file tests what stays without them.
NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_registration():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(NAMES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["NAME_0", "NAME_1", "SurveyId"] and df.count() > 0


def test_ordered_output_is_in_order(spark):
    """The comparison sorts rows, so the order itself is looked at here."""
    rows = QUERIES["ordered_output"](spark, FOLDER).select("NAME_1", "SurveyId").collect()
    keys = [tuple((v is None, v) for v in r) for r in rows]
    assert len(keys) > 100 and keys == sorted(keys)
