"""Column builders: null rules, dates, scalar recodes and aggregate expressions."""

from panelspark.functions.aggregates import (
    date_summary,
    na_avg,
    na_max,
    na_min,
    weighted_mean_na,
    weighted_mean_skip,
)
from panelspark.functions.dates import (
    epoch_days,
    month_from_file_name,
    month_key,
    month_start,
    parse_date,
)
from panelspark.functions.nulls import (
    as_column,
    flag_below,
    null_safe_paste,
    peak_na,
    sentinel_null,
    text_to_double,
)
from panelspark.functions.scalars import (
    fix_mojibake,
    programme_wave,
    recode,
    split_pair,
    water_minutes,
    wealth_rank,
    year_in_name,
)

__all__ = [
    "as_column",
    "date_summary",
    "epoch_days",
    "fix_mojibake",
    "flag_below",
    "month_from_file_name",
    "month_key",
    "month_start",
    "na_avg",
    "na_max",
    "na_min",
    "null_safe_paste",
    "parse_date",
    "peak_na",
    "programme_wave",
    "recode",
    "sentinel_null",
    "split_pair",
    "text_to_double",
    "water_minutes",
    "wealth_rank",
    "weighted_mean_na",
    "weighted_mean_skip",
    "year_in_name",
]
