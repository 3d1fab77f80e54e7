"""Dates at day and month grain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.nulls import as_column

# English month names in calendar order.
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)


def month_start(year: Column | str, month: Column | str) -> Column:
    """First day of a month; NULL when the month number is not 1..12."""
    y, m = as_column(year).cast("int"), as_column(month).cast("int")
    return F.when(m.between(1, 12) & y.between(1, 9999), F.make_date(y, m, F.lit(1)))


def month_key(date: Column | str) -> Column:
    return F.trunc(as_column(date), "month")


def epoch_days(date: Column | str) -> Column:
    return F.unix_date(as_column(date))


def parse_date(text: Column | str, pattern: str = "yyyy-MM-dd") -> Column:
    """Date from text, NULL when it does not parse.

    A two-digit year follows the usual pivot: 69..99 lie in the 1900s.
    """
    day = F.try_to_timestamp(as_column(text), F.lit(pattern)).cast("date")
    if "yy" in pattern and "yyyy" not in pattern:
        return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
    return day


def month_from_file_name(name: Column | str) -> Column:
    """Month start from a file name that spells the month and carries the year.

    File listings sort such names alphabetically (April first), so the date has
    to come from the name and never from the position in the listing.
    """
    text = as_column(name)
    word = F.lower(F.regexp_extract(text, r"(?i)(" + "|".join(MONTH_NAMES) + ")", 1))
    number = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTH_NAMES]), word)
    return month_start(F.regexp_extract(text, r"(\d{4})", 1).try_cast("int"), number)


def month_steps(start: Column | str, end: Column | str) -> Column:
    """Array of month starts, both ends included.  Explode it for one row per month."""
    return F.sequence(
        F.to_date(F.lit(start) if isinstance(start, str) else start),
        F.to_date(F.lit(end) if isinstance(end, str) else end),
        F.expr("interval 1 month"),
    )
