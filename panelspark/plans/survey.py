"""Survey microdata to located child records, prevalence rates and interview months."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import (
    flag_below,
    month_start,
    programme_wave,
    text_to_double,
    water_minutes,
    wealth_rank,
)
from panelspark.operators.aggregate import rate_parts, rates_of
from panelspark.operators.joins import lookup_join
from panelspark.operators.reshape import stack
from panelspark.operators.spatial import SEGMENT, assign_units
from panelspark.session import written

UNIT = ("NAME_0", "NAME_1")
WAVE = ("NAME_0", "NAME_1", "SurveyId")
ZSCORES = {"hc72": "whz2", "hc70": "haz2", "hc71": "waz2"}
RATES = {"wasted_prev": "whz2", "stunted_prev": "haz2", "under_prev": "waz2"}
# Age bound in months, first code that is no z-score, flag limit,
# decimals hidden in coded z-scores and in survey weights.
MAX_AGE, FIRST_BAD_CODE, CUTOFF = 59, 9995, -2
ZSCORE_SCALE, WEIGHT_SCALE = 100, 1_000_000
# Field work of the later programme in 2013 and 2014 is one wave.
PROGRAMME_WAVES = {2007: 2007, 2009: 2009, 2011: 2011, 2013: 2013, 2014: 2013}


def clean_children(children: DataFrame) -> DataFrame:
    """Children under five with valid z-scores: scaled scores, flags, interview month."""
    valid = text_to_double("hc1") <= MAX_AGE
    for z in ZSCORES:
        valid = valid & (text_to_double(z) < FIRST_BAD_CODE)
    kept = children.where(valid)
    scaled = kept.withColumns({z: text_to_double(z) / ZSCORE_SCALE for z in ZSCORES})
    return scaled.withColumns(
        {
            **{flag: flag_below(z, CUTOFF) for z, flag in ZSCORES.items()},
            "month": F.col("hc18"),
            "year": F.col("hc19"),
            "ymd": month_start("hc19", "hc18"),
        }
    )


def locate_clusters(
    clusters: DataFrame, edges: DataFrame, unit: Sequence[str] = UNIT
) -> DataFrame:
    """Unit of each survey cluster: one row per (survey, cluster), located once.

    The edges are written, so that the unit index, which reads them three times, does not plan them as often.
    """
    edges, _ = written(edges.select(*unit, *SEGMENT), "edges")
    places = (
        clusters.where(F.col("LATNUM").isNotNull() & F.col("LONGNUM").isNotNull())
        .groupBy("SurveyId", "CLUSTER")
        .agg(F.min_by("LONGNUM", F.struct("LONGNUM", "LATNUM")).alias("LONGNUM"),
             F.min_by("LATNUM", F.struct("LONGNUM", "LATNUM")).alias("LATNUM"))
    )
    return assign_units(places, edges, unit, "LONGNUM", "LATNUM", "left")


def survey_working(
    children: DataFrame, clusters: DataFrame, edges: DataFrame, unit: Sequence[str] = UNIT
) -> DataFrame:
    """Cleaned child records with coordinates, country code and administrative unit.

    Only clusters meet the polygons; records pick the unit up by (survey, cluster),
    so two waves that reuse a cluster number do not mix.  Records of clusters
    without coordinates drop out; clusters outside every unit keep a NULL unit.
    """
    located = locate_clusters(clusters, edges, unit)
    records = clean_children(children).withColumn("cc", F.substring("SurveyId", 1, 2))
    return lookup_join(records, located, ["SurveyId", "CLUSTER"], "inner")


def household_recodes(df: DataFrame) -> DataFrame:
    """Wealth rank, birth interval and minutes to water from coded answers."""
    return df.withColumns(
        {
            "wealth": wealth_rank("hv270"),
            "prebirthinterval": text_to_double("hc63"),
            "timetowater": water_minutes("hv204"),
        }
    )


def wave_months(children: DataFrame) -> DataFrame:
    """Child records summed per unit, wave and month: the one pass over the microdata.

    Both the prevalence table and the interview counts follow from it.  Children that lie
    in no unit belong to no row of the panel and are left out before grouping.
    """
    located = children.where(F.col("NAME_0").isNotNull() & F.col("NAME_1").isNotNull())
    return rate_parts(located, [*WAVE, "ymd"], RATES, F.col("hv005") / WEIGHT_SCALE)


def prevalence_of(months: DataFrame) -> DataFrame:
    return rates_of(months, WAVE, list(RATES), "ymd")


def prevalence(children: DataFrame) -> DataFrame:
    """Weighted prevalence per unit and wave, with interview dates and record count."""
    return prevalence_of(wave_months(children))


def _programme(
    surveys: DataFrame,
    countries: Sequence[str],
    programme: str,
    waves: Mapping[int, int] | None,
) -> DataFrame:
    return (
        surveys.where(F.col("country").isin(list(countries)) & (F.col(programme) == 1))
        .withColumns(
            {
                "SurveyId": programme_wave("year", programme, waves),
                "ymd": month_start("year", "month"),
            }
        )
        .withColumnsRenamed({"country": "NAME_0", "adm1": "NAME_1"})
    )


def programme_records(
    surveys: DataFrame,
    countries: Sequence[str],
    waves: Mapping[int, int] | None = PROGRAMME_WAVES,
) -> DataFrame:
    """Pre-aggregated surveys of both programmes in the common key columns."""
    return stack(
        [_programme(surveys, countries, "MICS", waves), _programme(surveys, countries, "SMART", None)]
    )


def programme_wave_months(
    surveys: DataFrame,
    countries: Sequence[str],
    waves: Mapping[int, int] | None = PROGRAMME_WAVES,
) -> DataFrame:
    """The pre-aggregated surveys in the shape of :func:`wave_months`, weighted by respondents."""
    records = programme_records(surveys, countries, waves)
    respondents = F.col("respondents")
    return rate_parts(records, [*WAVE, "ymd"], RATES, respondents, n=respondents)


def programme_prevalence(
    surveys: DataFrame,
    countries: Sequence[str],
    waves: Mapping[int, int] | None = PROGRAMME_WAVES,
) -> DataFrame:
    """Respondent-weighted prevalence per unit and programme wave."""
    return prevalence_of(programme_wave_months(surveys, countries, waves))


def interview_months(months: DataFrame) -> DataFrame:
    """Interviews per unit, wave and month, from a table of wave months."""
    return months.select(*WAVE, "ymd", F.col("n").cast("double"))
