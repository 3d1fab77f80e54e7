"""Climate: region-month sources to a unit-month panel, and to survey waves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.aggregates import date_summary
from panelspark.operators import panel as P
from panelspark.operators.aggregate import summarise_columns
from panelspark.operators.joins import rename_units
from panelspark.operators.reshape import stack
from panelspark.plans.survey import UNIT, WAVE

SEASON = "peak3_14"
SURVEY_SEASON_LAGS = tuple(range(1, 8))


def climate_panel(
    sources: Mapping[str, DataFrame],
    countries: Sequence[str] | None,
    start: str,
    end: str,
    names: Mapping[str, str] | DataFrame | None = None,
    units: DataFrame | None = None,
) -> DataFrame:
    """Lags, five-year anomalies, three-month seasons and time from peak, per unit-month.

    ``sources`` maps a variable to its long table ``(NAME_0, NAME_1, ymd, <variable>)``.
    Countries are filtered first.  The sources are stacked rather than joined: one
    aggregation by unit and month lines the variables up, averages regions that share
    a unit, and adds the months nobody reported.  From there on all lags run on one
    partitioning by unit, in two window passes (base, season).
    """
    variables = list(sources)
    keys = [*UNIT, "ymd"]

    def wanted(df: DataFrame) -> DataFrame:
        return df if countries is None else df.where(F.col("NAME_0").isin(list(countries)))

    rows = stack([wanted(df).select(*keys, v) for v, df in sources.items()])
    units = rows if units is None else wanted(units)
    if names is not None:
        rows = rename_units(rows, "NAME_1", names)
        units = rename_units(units, "NAME_1", names)
    blank = P.month_skeleton(units, UNIT, start, end)
    return add_indicators(P.one_row_per_step(rows, UNIT, "ymd", variables, blank), variables)


def add_indicators(panel: DataFrame, variables: Sequence[str]) -> DataFrame:
    seasons = [f"{v}_{SEASON}" for v in variables]
    base = P.anomalies(P.lag_panel(panel, UNIT, "ymd", variables), variables)
    seasonal = P.season_peaks(P.three_month_means(base, variables), variables)
    lagged = P.lag_panel(seasonal, UNIT, "ymd", seasons, P.SEASON_OFFSETS)
    return P.time_from_peak(P.anomalies(lagged, seasons), variables)


def climate_at_survey(
    interviews: DataFrame, climate: DataFrame, variables: Sequence[str]
) -> DataFrame:
    """Climate around the interview months, weighted by interviews, per unit and wave.

    ``interviews`` is ``(NAME_0, NAME_1, SurveyId, ymd, n)`` with the surveys of all
    programmes stacked, so they share one join and one aggregation.
    """
    season = [
        P.lag_name(f"{v}_{SEASON}", k) for v in variables for k in SURVEY_SEASON_LAGS
    ]
    tfp = [f"tfp_{v}" for v in variables]
    needed = climate.select(*UNIT, "ymd", *tfp, *season)
    months = interviews.join(needed, [*UNIT, "ymd"], "left")
    # A wave has one row per interview month here, so the dates need no counting.
    return summarise_columns(
        months,
        WAVE,
        "n",
        means={**{f"{c}_mean": c for c in tfp}, **{c: c for c in season}},
        mins={f"{c}_min": c for c in tfp},
        maxs={f"{c}_max": c for c in tfp},
        extra=date_summary("ymd"),
    )
