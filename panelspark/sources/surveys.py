"""Survey microdata that has already landed: choose, project, decode, locate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.joins import lookup_join
from panelspark.operators.reshape import decode_labels, select_present


def choose_surveys(
    catalog: DataFrame,
    countries: Sequence[str],
    survey_type: str,
    file_type: str,
    first_year: int,
    last_year: int,
) -> DataFrame:
    return catalog.where(
        F.col("country").isin(list(countries))
        & (F.col("surveyType") == survey_type)
        & (F.col("fileType") == file_type)
        & F.col("surveyYear").between(first_year, last_year)
    )


def load_chosen(
    microdata: DataFrame,
    chosen: DataFrame,
    variables: Sequence[str],
    labels: Mapping[str, Mapping[object, str]] | None = None,
) -> DataFrame:
    """Records of the chosen surveys, wanted variables only, codes decoded.

    The survey list is one row per survey, so the semi join is a broadcast filter
    on the scan and prunes partitions when the microdata is stored by survey.
    """
    records = select_present(microdata, ["SurveyId", *[v for v in variables if v != "SurveyId"]])
    kept = lookup_join(records, chosen.select("SurveyId").distinct(), ["SurveyId"], "left_semi")
    return decode_labels(kept, labels or {})


def attach_coordinates(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster coordinates beside each record; the key includes the survey."""
    keys = ["SurveyId", "CLUSTER"]
    places = clusters.select(*keys, "LONGNUM", "LATNUM")
    return lookup_join(records, places, keys, "left")
