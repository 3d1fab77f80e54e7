"""Joins and reshaping, with hot and NULL keys."""

import pytest
from pyspark.sql import functions as F

from panelspark.operators import joins as J
from panelspark.operators import reshape as R


def bag(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of the big side share one key, some keys are NULL."""
    big = spark.range(300).select(
        F.when(F.col("id") % 3 != 0, 7).when(F.col("id") % 9 == 0, None).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("v"),
    )
    small = spark.createDataFrame([(7, "a"), (7, "b"), (3, "c"), (None, "n"), (999, "z")], "k long, s string")
    return big, small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_plain_join(hot, how):
    big, small = hot
    cols = ["k", "v"] if how.startswith("left_") else ["k", "v", "s"]
    plain = big.join(small, ["k"], how)
    assert bag(J.split_join(big, small, ["k"], how, rows_per_task=10), *cols) == bag(plain, *cols)


def test_split_join_spreads_equal_rows(spark):
    big = spark.createDataFrame([(1,)] * 1000, "k int")
    small = spark.createDataFrame([(1, "a")], "k int, s string")
    joined = J.split_join(big, small, ["k"], rows_per_task=10)
    assert joined.count() == 1000
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "row_index" in plan and "__salt" in plan


def test_split_join_refuses_full(hot):
    with pytest.raises(ValueError):
        J.split_join(*hot, ["k"], "full")


def test_split_join_spreads_the_hot_key(hot):
    big, small = hot
    joined = J.split_join(big, small, ["k"], "inner", rows_per_task=10)
    assert "__salt" in joined._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("per_task", [10, 10**6])
def test_split_join_does_not_broadcast_the_other_side(spark, hot, per_task):
    """An exploded side is many times its estimate, so it is moved, not gathered in the driver."""
    big, small = hot
    many = small.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(27))))
    plan = J.split_join(big, many, ["k"], rows_per_task=per_task)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == (2 if per_task == 10 else 0)


def test_lookup_join_beyond_bound_equals_broadcast(hot):
    big, small = hot
    a = J.lookup_join(big, small, ["k"], "left")
    b = J.lookup_join(big, small, ["k"], "left", max_rows=1)
    assert "Broadcast" in a._jdf.queryExecution().executedPlan().toString()
    assert bag(a, "k", "v", "s") == bag(b, "k", "v", "s")


def test_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, b int")
    assert bag(J.null_safe_join(a, b, ["k"], "left"), "k", "a", "b") == [("x", 2, None), (None, 1, 10)]
    assert len(bag(J.null_safe_join(a, b, ["k"], "full"), "k", "a", "b")) == 3
    assert bag(a.join(b, "k", "left"), "k", "a", "b") == [("x", 2, None), (None, 1, None)]


def test_natural_full_join(spark):
    a = spark.createDataFrame([("x", 1, 5)], "k string, y int, a int")
    b = spark.createDataFrame([("x", 1, 6), ("x", 2, 7)], "k string, y int, b int")
    assert bag(J.natural_full_join(a, b), "k", "y", "a", "b") == [("x", 1, 5, 6), ("x", 2, None, 7)]


def test_name_mismatch(spark):
    a = spark.createDataFrame([("K", "n1"), ("K", "n1"), ("K", "n2")], "c string, n string")
    b = spark.createDataFrame([("K", "n2"), ("K", "n3")], "c string, n string")
    assert bag(J.name_mismatch(a, b, ["c", "n"]), "n", "side") == [("n1", "left"), ("n3", "right")]
    assert J.name_mismatch(a, a, ["c", "n"]).count() == 0


def test_crosswalk_literal_equals_table(spark):
    df = spark.createDataFrame([("old1",), ("old2",), ("same",), (None,)], "NAME_1 string")
    names = {"old1": "new", "old2": "new"}
    table = spark.createDataFrame(list(names.items()), "old_name string, new_name string")
    assert bag(J.rename_units(df, "NAME_1", names), "NAME_1") == bag(J.rename_units(df, "NAME_1", table), "NAME_1")


def test_month_names_and_width(spark):
    assert len(R.month_names("2002-07-01", "2015-06-01")) == 156
    assert R.month_names("2002-11-01", "2003-02-01") == ["2002-11-01", "2002-12-01", "2003-01-01", "2003-02-01"]
    df = spark.range(1).select(*[F.lit(1.0).alias(f"v{k}") for k in range(155)])
    with pytest.raises(ValueError, match="155 month columns"):
        R.name_months(df, "2002-07-01", "2015-06-01")


def test_unpivot_keeps_nulls_and_pivot_returns(spark):
    wide = spark.createDataFrame([("u", 1.0, None)], "k string, a double, b double")
    long = R.to_long(wide, ["k"], "name", "value")
    assert bag(long, "name", "value") == [("a", 1.0), ("b", None)]
    assert bag(R.to_wide(long, ["k"], "name", "value", ["a", "b"]), "k", "a", "b") == [("u", 1.0, None)]


def test_stack_aligns_types_and_columns(spark):
    a = spark.createDataFrame([(1, "x")], "n int, only_a string")
    b = spark.createDataFrame([(2.5,)], "n double")
    out = R.stack([a, b])
    assert out.schema["n"].dataType.simpleString() == "double"
    assert bag(out, "n", "only_a") == [(1.0, "x"), (2.5, None)]


def test_fallback_and_patterns(spark):
    df = spark.range(1).select(F.lit("A").alias("iso"), F.lit(1.0).alias("gpw_2000_mean"), F.lit(2.0).alias("gpw_2000_sum"))
    assert R.with_fallback(df, {"iso": "NAME_0"}).columns[0] == "NAME_0"
    assert R.select_matching(df, ["gpw"], "mean", keep=["iso"]).columns == ["iso", "gpw_2000_mean"]
    assert R.select_present(df, ["iso", "missing"]).columns == ["iso"]


def panels(spark):
    a = spark.createDataFrame([("x", 1, 5), ("x", 1, 6), ("y", 2, 7), (None, 1, 8), ("z", 9, None)], "k string, m int, a int")
    b = spark.createDataFrame([("x", 1, 50), ("x", 1, 60), ("x", 1, 70), (None, 1, 80), ("w", 4, 90)], "k string, m int, b int")
    c = spark.createDataFrame([("w", 4, 900), ("y", 2, 700), ("y", 2, 701)], "k string, m int, c int")
    return a, b, c


@pytest.mark.parametrize("many", [1000, 2, 0])
def test_full_join_equals_the_chain(spark, many):
    """Duplicates, NULL keys and NULL values; gathered, and with hot keys joined apart."""
    a, b, c = panels(spark)
    chain = a.join(b, ["k", "m"], "full").join(c, ["k", "m"], "full")
    assert bag(J.full_join([a, b, c], ["k", "m"], many), "k", "m", "a", "b", "c") == bag(chain, "k", "m", "a", "b", "c")
    assert bag(J.full_join([a, b.limit(0)], ["k", "m"], many), "k", "m", "a", "b") == bag(a.join(b.limit(0), ["k", "m"], "full"), "k", "m", "a", "b")


def test_full_join_shuffles_once(spark):
    a, b, c = panels(spark)
    joined = J.full_join([a, b, c], ["k", "m"])
    assert joined._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
