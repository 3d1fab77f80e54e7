"""Aggregate expressions with explicit null rules.  All merge map-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.nulls import as_column


def _complete(c: Column) -> Column:
    return F.count(c) == F.count(F.lit(1))


def na_avg(c: Column | str) -> Column:
    """Mean that is NULL when any value is NULL."""
    c = as_column(c)
    return F.when(_complete(c), F.avg(c))


def na_min(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(_complete(c), F.min(c))


def na_max(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(_complete(c), F.max(c))


def weighted_mean_na(x: Column | str, w: Column | str) -> Column:
    """Weighted mean; NULL when a value with non-zero weight, or any weight, is NULL."""
    x, w = as_column(x), as_column(w)
    spoiled = F.count_if((x.isNull() & (w != 0)) | w.isNull())
    return F.when(spoiled == 0, F.try_divide(F.sum(x * w), F.sum(w)))


def weighted_mean_skip(x: Column | str, w: Column | str) -> Column:
    """Weighted mean over rows with a value; a NULL weight among those spoils it."""
    x, w = as_column(x), as_column(w)
    known = x.isNotNull()
    spoiled = F.count_if(known & w.isNull())
    return F.when(spoiled == 0, F.try_divide(F.sum(x * w), F.sum(F.when(known, w))))


def date_summary(date: Column | str, rows: Column | str | None = None) -> dict[str, Column]:
    """First, last, mean and median date of a group.

    ``rows`` says how often each date occurs.  Feed it counts per (group, date):
    the exact median then buffers one entry per distinct date of a group, however
    many records the group has.  Mean and median are epoch days (a mean date is
    fractional).  All four are NULL when a date is missing.
    """
    d = as_column(date)
    n = F.lit(1) if rows is None else as_column(rows)
    whole = F.coalesce(F.sum(F.when(d.isNull(), n)), F.lit(0)) == 0
    day = F.unix_date(d)
    return {
        "first_month": F.when(whole, F.min(d)),
        "last_month": F.when(whole, F.max(d)),
        "mean_month": F.when(whole, F.try_divide(F.sum(day * n), F.sum(n))),
        "median_month": F.when(whole, F.percentile(day, F.lit(0.5), n)),
    }
