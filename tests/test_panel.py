"""Panel operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.operators import panel as P
from panelspark.operators import reshape as R
from panelspark.plans.covariates import yearly_covariates, yearly_series


def months(n, start=2000):
    return [dt.date(start + k // 12, k % 12 + 1, 1) for k in range(n)]


def test_row_lag_on_a_gap(spark):
    m = months(4)
    df = spark.createDataFrame([("u", m[0], 1.0), ("u", m[1], 2.0), ("u", m[3], 4.0)], "u string, ymd date, v double")
    full = P.on_skeleton(df, ["u"], "2000-01-01", "2000-04-01")
    got = {r["ymd"]: r["lag_v_1"] for r in P.lag_panel(full, ["u"], "ymd", ["v"], [1]).collect()}
    assert got == {m[0]: None, m[1]: 1.0, m[2]: 2.0, m[3]: None}


def test_lag_panel_equals_explode_lag_pivot(spark):
    rows = [(u, d, float((hash(u) + 7 * k) % 11)) for u in "ab" for k, d in enumerate(months(70))]
    df = spark.createDataFrame(rows, "u string, ymd date, v double")
    wide = P.lag_panel(df, ["u"], "ymd", ["v"])
    offsets = [k for k in P.BASE_OFFSETS if k]
    later = R.explode_offsets(df, offsets).select(
        "u", F.expr("cast(add_months(ymd, n_lag) AS date)").alias("ymd"), F.concat(F.lit("lag_v_"), "n_lag").alias("name"), "v"
    )
    pivoted = R.to_wide(later, ["u", "ymd"], "name", "v", [f"lag_v_{k}" for k in offsets])
    cols = ["u", "ymd", *[f"lag_v_{k}" for k in offsets]]
    base = df.select("u", "ymd").join(pivoted, ["u", "ymd"], "left")
    assert sorted(map(tuple, wide.select(*cols).collect()), key=str) == sorted(map(tuple, base.select(*cols).collect()), key=str)


def test_all_lags_share_one_window_pass(spark):
    df = spark.range(1).select(F.lit("u").alias("u"), F.current_date().alias("ymd"), F.lit(1.0).alias("a"), F.lit(2.0).alias("b"))
    plan = P.lag_panel(df, ["u"], "ymd", ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_time_from_peak_tie_and_null(spark):
    values = [5.0] * 1 + [1.0] * 10 + [9.0, 9.0, 2.0, 3.0]
    df = spark.createDataFrame([("u", d, v) for d, v in zip(months(15), values)], "u string, ymd date, v double")
    out = P.time_from_peak(P.lag_panel(df, ["u"], "ymd", ["v"]), ["v"])
    last = out.orderBy(F.desc("ymd")).first()
    assert (last["peak_v"], last["tfp_v"]) == (9.0, 2)
    assert out.where("ymd = '2000-06-01'").first()["tfp_v"] is None


def test_season_and_anomaly_null_rules(spark):
    df = spark.createDataFrame([("u", d, float(k)) for k, d in enumerate(months(61))], "u string, ymd date, v double")
    out = P.anomalies(P.season_peaks(P.three_month_means(P.lag_panel(df, ["u"], "ymd", ["v"]), ["v"]), ["v"]), ["v"])
    last = out.orderBy(F.desc("ymd")).first()
    assert last["v_5avg"] == sum(60 - k for k in (12, 24, 36, 48, 60)) / 5
    assert last["v_dev5"] == 60 - last["v_5avg"]
    assert last["v_mean3_1"] == 58.0 and last["v_peak3_12"] == last["v_peak3_14"] == 58.0
    early = out.where("ymd = '2001-01-01'").first()
    assert early["v_peak3_12"] == 10.0 and early["v_peak3_14"] is None and early["v_5avg"] is None


def test_carry_forward(spark):
    df = spark.createDataFrame([("u", 2000 + k, v) for k, v in enumerate([None, 5, None, 7, None])], "u string, year int, v int")
    got = [r["v"] for r in P.carry_forward(df, ["u"], "year", ["v"]).orderBy("year").collect()]
    assert got == [None, 5, 5, 7, 7]


def test_extend_and_shift(spark):
    df = spark.createDataFrame([("u", 2013, 1), ("u", 2014, 2)], "u string, year int, v int")
    out = P.shift_years(P.extend_last_year(df, 2014, [2015, 2016]))
    assert sorted(map(tuple, out.collect())) == [("u", 2014, 1), ("u", 2015, 2), ("u", 2016, 2), ("u", 2017, 2)]
    assert out.schema["year"].dataType.simpleString() == "int"


def test_zero_filled(spark):
    units = spark.createDataFrame([("u",), ("v",), ("u",)], "u string")
    blank = P.month_skeleton(units, ["u"], "2000-01-01", "2000-03-01")
    assert blank.count() == 6
    counts = spark.createDataFrame([("u", months(1)[0], 4)], "u string, ymd date, n int")
    filled = P.zero_filled(counts.union(counts), blank, ["u", "ymd"], "n")
    assert sorted(r["n"] for r in filled.collect()) == [0] * 5 + [8]


def test_one_row_per_step_with_skeleton(spark):
    m = months(3)
    rows = [("u", m[0], 1.0, None), ("u", m[0], 3.0, None), ("u", m[2], None, 5.0)]
    df = spark.createDataFrame(rows, "u string, ymd date, a double, b double")
    blank = P.month_skeleton(df, ["u"], "2000-01-01", "2000-03-01")
    out = P.one_row_per_step(df, ["u"], "ymd", ["a", "b"], blank).orderBy("ymd").collect()
    assert [(r["a"], r["b"]) for r in out] == [(2.0, None), (None, None), (None, 5.0)]


def test_two_columns_of_one_series_and_year_raise(spark):
    wide = spark.sql("SELECT 'a' AS NAME_0, 'b' AS NAME_1, 1.0D AS v_2001_x_mean, 2.0D AS v_2001_y_mean")
    with pytest.raises(ValueError, match="v_2001_x_mean and v_2001_y_mean"):
        yearly_series(wide, ["NAME_0", "NAME_1"], {"v": "v"}, 2001, 2001, suffix="mean")


def test_yearly_series_and_duplicates(spark):
    wide = spark.createDataFrame(
        [("A", "x", 1.0, 2.0, 9.0), ("A", "x", 3.0, 4.0, 9.0)],
        "NAME_0 string, NAME_1 string, gpw_2000_mean double, gpw_2002_mean double, road double",
    )
    long = yearly_series(wide, ["NAME_0", "NAME_1"], {"gpw": "gpw"}, 2000, 2003, {"road": "road"}, "mean")
    assert long.count() == 8
    out = yearly_covariates(wide, {"gpw": "gpw"}, 2000, 2003, ["gpw"], {"road": "road"}, "mean").orderBy("year").collect()
    assert [(r["year"], r["gpw"], r["gpw_lag1"], r["gpw_lag2"], r["road"]) for r in out] == [
        (2000, 2.0, None, None, 9.0), (2001, 2.0, 2.0, None, 9.0), (2002, 3.0, 2.0, 2.0, 9.0), (2003, 3.0, 3.0, 2.0, 9.0),
    ]
