"""Grouped summaries.

Where an exact median is asked for, records are first counted per (group, date).
That pass combines map-side, so a group holding a third of all records costs one
row per task, and the median then works on a handful of dates with frequencies.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions import aggregates as A
from panelspark.functions.nulls import as_column
from panelspark.operators.joins import BROADCAST_ROWS, null_safe_join, sized


def group_count(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def date_stats(
    df: DataFrame, keys: Sequence[str], date: str, rows: Column | None = None
) -> DataFrame:
    """First, last, mean and median date per group."""
    counted = df.groupBy(*keys, date).agg(
        (F.count(F.lit(1)) if rows is None else F.sum(rows)).alias("__rows")
    )
    return counted.groupBy(*keys).agg(
        *[c.alias(n) for n, c in A.date_summary(date, "__rows").items()]
    )


def attach_date_stats(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """The group's date statistics beside each row.

    Aggregated and joined back rather than windowed: a window would move a whole
    group into one task.  The statistics are broadcast while few, so the rows stay put.
    """
    stats, groups = sized(date_stats(df, keys, date), "date_stats")
    side = F.broadcast(stats) if groups <= BROADCAST_ROWS else stats
    return null_safe_join(df, side, keys, "left")


def rate_parts(
    df: DataFrame,
    keys: Sequence[str],
    rates: Mapping[str, str],
    weight: Column | str,
    n: Column | None = None,
) -> DataFrame:
    """Sums per group from which weighted rates of any coarser grouping follow.

    Columns ``rows`` (records), ``n`` (records, or the sum of ``n``), and three sums
    per rate.  This is the one pass over the records; what follows is small.
    """
    w = as_column(weight)
    rows = F.count(F.lit(1))
    parts = [rows.alias("rows"), (rows if n is None else F.sum(n)).alias("n")]
    for out, src in rates.items():
        known = F.col(src).isNotNull()
        parts += [
            F.sum(F.col(src) * w).alias(f"__xw_{out}"),
            F.sum(F.when(known, w)).alias(f"__w_{out}"),
            F.count_if(known & w.isNull()).alias(f"__bad_{out}"),
        ]
    return df.groupBy(*keys).agg(*parts)


def rates_of(
    parts: DataFrame, keys: Sequence[str], rates: Sequence[str], date: str | None = None
) -> DataFrame:
    """Weighted rates, date statistics and n per group from ``rate_parts``."""

    def rate(out: str) -> Column:
        value = f"try_divide(sum(`__xw_{out}`), sum(`__w_{out}`))"
        return F.expr(f"CASE WHEN sum(`__bad_{out}`) = 0 THEN {value} END").alias(out)

    dates = A.date_summary(date, "rows").items() if date else ()
    return parts.groupBy(*keys).agg(
        *[rate(out) for out in rates], *[c.alias(name) for name, c in dates], F.sum("n").alias("n")
    )


def weighted_rates(
    df: DataFrame,
    keys: Sequence[str],
    rates: Mapping[str, str],
    weight: Column | str,
    date: str | None = None,
    n: Column | None = None,
) -> DataFrame:
    """Weighted mean of each source column per group, with date statistics and n.

    Rows without a value drop out of that rate; a NULL weight beside a value makes
    the rate NULL.  ``n`` is summed when given, else rows are counted.
    """
    fine = [*keys, *([date] if date else [])]
    return rates_of(rate_parts(df, fine, rates, weight, n), keys, list(rates), date)


def summarise_columns(
    df: DataFrame,
    keys: Sequence[str],
    weight: str,
    means: Mapping[str, str] | None = None,
    mins: Mapping[str, str] | None = None,
    maxs: Mapping[str, str] | None = None,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """NULL-propagating weighted means, minima and maxima over lists of columns.

    Every output reads the source column, never an output of the same call.
    ``extra`` adds further aggregates to the same pass.
    """
    w = f"`{weight}`"

    def mean(x: str) -> Column:
        spoiled = f"count_if((`{x}` IS NULL AND {w} <> 0) OR {w} IS NULL)"
        return F.expr(f"CASE WHEN {spoiled} = 0 THEN try_divide(sum(`{x}` * {w}), sum({w})) END")

    def end(f: str, x: str) -> Column:
        return F.expr(f"CASE WHEN count(`{x}`) = count(1) THEN {f}(`{x}`) END")

    out = [c.alias(n) for n, c in (extra or {}).items()]
    out += [mean(src).alias(n) for n, src in (means or {}).items()]
    out += [end("min", src).alias(n) for n, src in (mins or {}).items()]
    out += [end("max", src).alias(n) for n, src in (maxs or {}).items()]
    return df.groupBy(*keys).agg(*out)


def mean_all(df: DataFrame, keys: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Mean of every numeric column outside the keys; all-NULL groups give NULL."""
    skip = {*keys, *drop}
    nums = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]
    return df.groupBy(*keys).agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in nums])


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``row`` by stated values of ``column``, zero where none."""
    return (
        df.groupBy(row)
        .pivot(column, list(values))
        .agg(F.count(F.lit(1)))
        .fillna(0, subset=list(values))
    )


def ranked_means(
    df: DataFrame, keys: Sequence[str], value: str, within: Sequence[str], name: str = "m"
) -> DataFrame:
    """Group means ranked high to low inside each facet (missing means last)."""
    means = df.groupBy(*keys).agg(F.avg(value).alias(name))
    order = [F.desc_nulls_last(name), *[F.asc_nulls_last(k) for k in keys if k not in within]]
    return means.withColumn("rank", F.row_number().over(W.partitionBy(*within).orderBy(*order)))


def wave_on_wave(
    df: DataFrame, unit: Sequence[str], wave: str, value: str, name: str = "m"
) -> DataFrame:
    """Mean per unit and wave beside the mean of the unit's previous wave."""
    means = df.groupBy(*unit, wave).agg(F.avg(value).alias(name))
    return means.withColumn(
        f"{name}_previous", F.lag(name, 1).over(W.partitionBy(*unit).orderBy(wave))
    )
