"""Null rules.  Missing values are NULL from ingest on; nothing else marks them."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_to_double(c: Column | str) -> Column:
    """Number from text; text that is no number becomes NULL instead of an error."""
    return as_column(c).try_cast("double")


def sentinel_null(
    c: Column | str,
    codes: Iterable[float] = (),
    at_least: float | None = None,
    finite_only: bool = True,
) -> Column:
    """NULL for coded missing values, for codes from a bound upwards, for NaN and Inf."""
    value = as_column(c)
    bad = F.lit(False)
    codes = list(codes)
    if codes:
        bad = bad | value.isin(codes)
    if at_least is not None:
        bad = bad | (value >= at_least)
    if finite_only:
        real = value.cast("double")
        bad = bad | F.isnan(real) | (F.abs(real) == float("inf"))
    return F.when(~bad, value)


def flag_below(c: Column | str, limit: float) -> Column:
    """1 when strictly below the limit, 0 when not, NULL when unknown."""
    return (as_column(c) < limit).cast("int")


def all_present(cols: Iterable[Column | str]) -> Column:
    return reduce(lambda a, b: a & b, [as_column(c).isNotNull() for c in cols])


def peak_na(*cols: Column | str) -> Column:
    """Row-wise maximum that is NULL as soon as one argument is NULL."""
    parts = [as_column(c) for c in cols]
    top = parts[0] if len(parts) == 1 else F.greatest(*parts)
    return F.when(all_present(parts), top)


def null_safe_paste(*cols: Column | str, sep: str = "") -> Column:
    """Join as text, a NULL printing as ``NA``."""
    return F.concat_ws(
        sep, *[F.coalesce(as_column(c).cast("string"), F.lit("NA")) for c in cols]
    )
