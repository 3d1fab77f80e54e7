"""Stand-in inputs: which sides of their joins are gathered in the driver."""

import datetime as dt

import pytest

from checks.q_groups import REGIONS, WAVES, located_children
from checks.q_panel import interviews
from checks.standins import Inputs
from panelspark.operators.reshape import stack
from panelspark.plans import survey as V

TABLES = {
    "region": ("r_regionkey long, r_name string", [(0, "AFRICA")]),
    "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "ALGERIA", 0), (1, "EGYPT", 0)]),
    # Keys repeat and are missing on either side.
    "customer": ("c_custkey long, c_nationkey long", [(1, 0), (2, 1), (2, 1), (None, 0), (3, None)]),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderdate date",
        [(10, 1, dt.date(1996, 2, 3)), (11, 2, dt.date(1996, 2, 9)), (11, 3, dt.date(1997, 1, 1)), (None, 1, None), (12, None, None)],
    ),
    "lineitem": (
        "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
        "l_discount double, l_shipdate date",
        [(k, n, 5, 7, 2.0, 3.0, 0.1, dt.date(1996, 3, 1)) for n, k in enumerate([10, 10, 11, 12, 13, None])],
    ),
}


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return Inputs(spark, str(folder))


@pytest.mark.parametrize("name, moved, rows", [("resp", 2, 4), ("panel", 2, 2), ("covariates_wide", 1, 2)])
def test_tables_that_grow_are_not_broadcast(inputs, name, moved, rows):
    """Compressed files of orders and customers pass for small long after their rows have filled a driver's heap."""
    df = getattr(inputs, name)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == moved
    assert plan.count("BroadcastHashJoin") == 2  # nations and regions
    assert df.count() == rows


def test_interviews_bring_no_survey_joins_into_a_panel(inputs):
    """The driver would plan them again after every stage of the panel's plan."""
    df = interviews(inputs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1
    months = [V.wave_months(located_children(inputs)), V.programme_wave_months(inputs.surveys_agg, REGIONS, WAVES)]
    rows = sorted(map(tuple, df.collect()), key=str)
    assert rows and rows == sorted(map(tuple, V.interview_months(stack(months)).collect()), key=str)
