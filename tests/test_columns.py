"""Null rules, dates, recodes and aggregate expressions on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from panelspark.functions import (
    epoch_days,
    fix_mojibake,
    flag_below,
    month_from_file_name,
    month_start,
    na_avg,
    na_max,
    na_min,
    null_safe_paste,
    parse_date,
    peak_na,
    programme_wave,
    sentinel_null,
    split_pair,
    text_to_double,
    water_minutes,
    wealth_rank,
    weighted_mean_na,
    weighted_mean_skip,
    year_in_name,
)
from panelspark.operators.aggregate import attach_date_stats, date_stats, rate_parts, weighted_rates


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(expr).collect()]


def test_flag_keeps_null(spark):
    assert column(spark, [-3.0, -2.0, None], "double", flag_below("v", -2)) == [1, 0, None]


def test_sentinels(spark):
    values = [1.0, -9999.0, float("nan"), float("inf"), float("-inf"), None]
    assert column(spark, values, "double", sentinel_null("v", [-9999.0])) == [1.0] + [None] * 5
    assert column(spark, [9994, 9995, None], "int", sentinel_null("v", at_least=9995)) == [9994, None, None]


def test_bad_number_is_null(spark):
    assert column(spark, ["12", "x", None, "1e2"], "string", text_to_double("v")) == [12.0, None, None, 100.0]


def test_peak_propagates_null(spark):
    df = spark.createDataFrame([(1, None, 3), (1, 2, 3)], "a int, b int, c int")
    assert [r[0] for r in df.select(peak_na("a", "b", "c")).collect()] == [None, 3]


def test_paste_prints_na(spark):
    assert column(spark, ["x", None], "string", null_safe_paste(F.lit("a"), "v", sep="-")) == ["a-x", "a-NA"]


def test_months_and_dates(spark):
    assert column(spark, [1, 12, 13, 0, None], "int", month_start(F.lit(2008), "v")) == [
        dt.date(2008, 1, 1), dt.date(2008, 12, 1), None, None, None,
    ]
    assert column(spark, ["31/12/2009", "32/12/2009"], "string", parse_date("v", "dd/MM/yyyy")) == [
        dt.date(2009, 12, 31), None,
    ]
    assert column(spark, ["05-Jan-08", "05-Jan-75"], "string", parse_date("v", "dd-MMM-yy")) == [
        dt.date(2008, 1, 5), dt.date(1975, 1, 5),
    ]
    names = ["t.April.1995.tif", "t.december.2016.tif", "none"]
    assert column(spark, names, "string", month_from_file_name("v")) == [
        dt.date(1995, 4, 1), dt.date(2016, 12, 1), None,
    ]


def test_recodes(spark):
    assert column(spark, ["poorest", "second", "richest", "?", None], "string", wealth_rank("v")) == [1, 2, 5, None, None]
    assert column(spark, ["on premises", "995+", "more than 12 hours", "35", "don't know"], "string", water_minutes("v")) == [
        0.0, 995.0, 720.0, 35.0, None,
    ]
    assert column(spark, [2013, 2014, 2010], "int", programme_wave("v", "MICS", {2013: 2013, 2014: 2013})) == [
        "2013MICS", "2013MICS", None,
    ]
    assert column(spark, [2010], "int", programme_wave("v", "SMART")) == ["2010SMART"]


def test_split_pair(spark):
    first, second = split_pair("v")
    values = ["Kenya_Meru North", "Kenya", "a_b_c"]
    assert column(spark, values, "string", second) == ["Meru North", None, "b"]
    assert column(spark, values, "string", first) == ["Kenya", "Kenya", "a"]


def test_mojibake(spark):
    values = ["TillabÃ©ry", "Tillabéry", "日本Ã©", "Ãa", None]
    assert column(spark, values, "string", fix_mojibake("v")) == ["Tillabéry", "Tillabéry", "日本Ã©", "Ãa", None]


def test_year_in_name():
    assert [year_in_name(c) for c in ("lights_1995_mean", "x20001_a", "none")] == [1995, None, None]


def one(df, *exprs):
    return tuple(df.agg(*[e.alias(f"e{k}") for k, e in enumerate(exprs)]).first())


def test_weighted_means(spark):
    keep = spark.createDataFrame([(1.0, 1.0), (None, 1.0)], "x double, w double")
    zero = spark.createDataFrame([(1.0, 1.0), (None, 0.0)], "x double, w double")
    heavy = spark.createDataFrame([(1.0, 1.0), (None, 5.0)], "x double, w double")
    empty = spark.createDataFrame([(None, 5.0)], "x double, w double")
    spoiled = spark.createDataFrame([(1.0, None), (2.0, 1.0)], "x double, w double")
    assert one(keep, weighted_mean_na("x", "w")) == (None,)
    assert one(zero, weighted_mean_na("x", "w")) == (1.0,)
    assert one(heavy, weighted_mean_skip("x", "w")) == (1.0,)
    assert one(empty, weighted_mean_skip("x", "w")) == (None,)
    assert one(spoiled, weighted_mean_skip("x", "w"), weighted_mean_na("x", "w")) == (None, None)


def test_extremes_propagate_null(spark):
    gap = spark.createDataFrame([(1.0,), (None,)], "x double")
    full = spark.createDataFrame([(1.0,), (4.0,)], "x double")
    assert one(gap, na_min("x"), na_max("x"), na_avg("x")) == (None, None, None)
    assert one(full, na_min("x"), na_max("x"), na_avg("x")) == (1.0, 4.0, 2.5)


def test_date_statistics(spark):
    days = [dt.date(2008, 1, 1), dt.date(2008, 2, 1)]
    df = spark.createDataFrame([("a", d) for d in days] + [("b", None), ("b", days[0])], "g string, ymd date")
    got = {r["g"]: r for r in date_stats(df, ["g"], "ymd").collect()}
    assert got["a"]["mean_month"] == got["a"]["median_month"] == 13894.5
    assert (got["a"]["first_month"], got["a"]["last_month"]) == tuple(days)
    assert got["b"]["mean_month"] is None and got["b"]["first_month"] is None
    floored = spark.range(1).select(F.date_from_unix_date(F.floor(F.lit(13894.5)).cast("int"))).first()[0]
    assert floored == dt.date(2008, 1, 16)
    assert attach_date_stats(df, ["g"], "ymd").count() == 4
    assert df.select(F.max(epoch_days("ymd"))).first()[0] == 13910


def test_rates_from_parts_equal_direct(spark):
    rows = [("a", dt.date(2008, m, 1), x, w) for m, x, w in [(1, 1, 2.0), (1, 0, 1.0), (2, None, 9.0), (2, 1, 1.0)]]
    df = spark.createDataFrame(rows, "g string, ymd date, flag int, w double")
    got = weighted_rates(df, ["g"], {"rate": "flag"}, "w", "ymd").first()
    assert got["rate"] == 3 / 4 and got["n"] == 4
    assert rate_parts(df, ["g", "ymd"], {"rate": "flag"}, "w").count() == 2
