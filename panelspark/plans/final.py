"""The end product: one row per unit and survey wave."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from panelspark.operators.reshape import stack
from panelspark.plans.climate import climate_at_survey
from panelspark.plans.conflict import events_at_survey
from panelspark.plans.survey import (
    PROGRAMME_WAVES,
    WAVE,
    interview_months,
    prevalence_of,
    programme_wave_months,
    wave_months,
)
from panelspark.session import written

MONTH_SUFFIX = "_month"


def final_panel(rates: DataFrame, climate: DataFrame, events: DataFrame) -> DataFrame:
    """Prevalence of all surveys with climate and conflict around their interviews.

    The rates keep their own interview dates; climate and conflict tables drop
    theirs.  Joined on unit and wave, waves known to only one side staying in.
    """

    def undated(df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in df.columns if c.endswith(MONTH_SUFFIX)])

    return rates.join(undated(climate), list(WAVE), "left").join(
        undated(events), list(WAVE), "full"
    )


def build_panel(
    children: DataFrame,
    surveys: DataFrame,
    climate: DataFrame,
    variables: Sequence[str],
    events: DataFrame,
    countries: Sequence[str],
    waves: Mapping[int, int] | None = PROGRAMME_WAVES,
) -> DataFrame:
    """The end product from its four inputs.

    The microdata and the pre-aggregated surveys are each read once: their sums per
    unit, wave and month are written, and rates and interview weights follow from those.
    """
    months = stack([wave_months(children), programme_wave_months(surveys, countries, waves)])
    months, _ = written(months, "wave_months")
    interviews = interview_months(months)
    return final_panel(
        prevalence_of(months),
        climate_at_survey(interviews, climate, variables),
        events_at_survey(interviews, events),
    )
