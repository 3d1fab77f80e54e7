"""Conflict: events to unit-month counts with lags, and to survey waves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.aggregates import date_summary
from panelspark.functions.dates import month_key
from panelspark.operators import panel as P
from panelspark.operators.aggregate import summarise_columns
from panelspark.operators.events import classify, integrate, location_days, unique_events
from panelspark.operators.spatial import SEGMENT, assign_units
from panelspark.plans.survey import UNIT, WAVE
from panelspark.session import written

MEASURE = "violent_events"
# Lags in months of the panel and of the table of survey waves.
PANEL_LAGS = tuple(range(1, 37))
SURVEY_LAGS = tuple(range(1, 25))


def integrated_events(
    events: DataFrame,
    taxonomy: DataFrame,
    order: Sequence[str],
    levels: Sequence[str],
    km: float = 4.0,
    days: int = 2,
) -> DataFrame:
    """Harmonised feeds without the entries an earlier source reports too, classified."""
    return classify(unique_events(integrate(events, taxonomy, order, levels, km, days)), taxonomy)


def event_counts(located: DataFrame, date: str = "date") -> DataFrame:
    """Location-days (the panel's measure) and events per unit and month.

    Points outside every unit are left out.
    """
    return (
        located.where(F.col("NAME_1").isNotNull())
        .groupBy(*UNIT, month_key(date).alias("ymd"))
        .agg(F.count(F.lit(1)).alias(MEASURE), F.sum("events").alias("n_events"))
    )


def event_panel(
    events: DataFrame,
    edges: DataFrame,
    start: str,
    end: str,
    wanted_class: str = "Violent Event",
    lags: Sequence[int] = PANEL_LAGS,
) -> DataFrame:
    """Zero-filled unit-month counts of one event class, with lags.

    The counts are written, a row per unit and month: what joins the panel is then planned without
    the entries behind it, whose plan the driver would otherwise hold and renew after every stage.
    So are the edges, which the unit index and the skeleton read four times.
    """
    edges, _ = written(edges.select(*UNIT, *SEGMENT), "edges")
    points = location_days(events, F.col("Level_4_text") == wanted_class)
    located = assign_units(points, edges, UNIT, how="inner")
    counts, _ = written(zero_filled_counts(located, edges, start, end), "unit_months")
    return P.lag_panel(counts, UNIT, "ymd", [MEASURE], lags)


def zero_filled_counts(located: DataFrame, units: DataFrame, start: str, end: str) -> DataFrame:
    """Location-days per unit and month, zero in quiet months: one aggregation."""
    ones = located.select(*UNIT, month_key("date").alias("ymd"), F.lit(1).alias(MEASURE))
    blank = P.month_skeleton(units, UNIT, start, end)
    return P.zero_filled(ones, blank, [*UNIT, "ymd"], MEASURE)


def events_at_survey(
    interviews: DataFrame, panel: DataFrame, lags: Sequence[int] = SURVEY_LAGS
) -> DataFrame:
    """Interview-weighted mean, minimum and maximum of counts and lags per unit and wave."""
    cols = [MEASURE, *[P.lag_name(MEASURE, k) for k in lags]]
    months = interviews.join(
        panel.select(*UNIT, "ymd", *cols), [*UNIT, "ymd"], "left"
    )
    return summarise_columns(
        months,
        WAVE,
        "n",
        means={c: c for c in cols},
        mins={f"{c}_min": c for c in cols},
        maxs={f"{c}_max": c for c in cols},
        extra=date_summary("ymd"),
    )
