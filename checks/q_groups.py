"""Aggregations, ordering and survey roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from panelspark.functions import flag_below, sentinel_null
from panelspark.functions import aggregates as A
from panelspark.operators import aggregate as G
from panelspark.plans import survey as V
from panelspark.plans.survey import UNIT, WAVE

DAYS = "date_diff('day', DATE '1970-01-01', ymd)"
DATES = f"""min(ymd) AS first_month, max(ymd) AS last_month, avg({DAYS}) AS mean_month,
    cast(quantile_cont({DAYS}, 0.5) AS double) AS median_month"""
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
# Field work of 1997 and 1998 counts as one wave; later years have no wave.
WAVES = {1995: 1995, 1996: 1996, 1997: 1997, 1998: 1997}

FLAGGED = """SELECT *, cast(CASE WHEN hc72 < 9995 THEN hc72 END / 1e2 < -2 AS int) AS whz2,
    cast(hc70 / 1e2 < -2 AS int) AS haz2, cast(CASE WHEN hc71 < 9995 THEN hc71 END / 1e2 < -2 AS int) AS waz2 FROM {resp}"""


def flagged(i):
    """Z-score flags with unknown scores kept as NULL."""
    return i.resp.withColumns(
        {
            flag: flag_below(sentinel_null(z, at_least=V.FIRST_BAD_CODE) / V.ZSCORE_SCALE, V.CUTOFF)
            for z, flag in V.ZSCORES.items()
        }
    )


def _rate(flag: str, weight: str) -> str:
    return f"sum({flag} * {weight}) / nullif(sum(CASE WHEN {flag} IS NOT NULL THEN {weight} END), 0)"


def prevalence_sql(children: str) -> str:
    return f"""SELECT NAME_0, NAME_1, SurveyId, {_rate('whz2', '(hv005 / 1e6)')} AS wasted_prev,
    {_rate('haz2', '(hv005 / 1e6)')} AS stunted_prev, {_rate('waz2', '(hv005 / 1e6)')} AS under_prev,
    {DATES}, count(*) AS n FROM ({children}) f GROUP BY NAME_0, NAME_1, SurveyId"""


# Cleaned children in the unit that their cluster lies in; those in no unit are out.
CHILDREN = """SELECT b.NAME_0, b.NAME_1, r.SurveyId, r.ymd, r.hv005, cast(hc72 / 1e2 < -2 AS int) AS whz2,
    cast(hc70 / 1e2 < -2 AS int) AS haz2, cast(hc71 / 1e2 < -2 AS int) AS waz2
    FROM {resp} r JOIN {clusters} c ON r.SurveyId = c.SurveyId AND r.CLUSTER = c.CLUSTER
    JOIN {nation_box} b ON c.LONGNUM > b.xa AND c.LONGNUM < b.xb AND c.LATNUM > b.ya AND c.LATNUM < b.yb
    WHERE hc1 <= 59 AND hc72 < 9995 AND hc71 < 9995 AND hc70 < 9995"""
PREVALENCE = prevalence_sql(CHILDREN)
PREVALENCE_DOUBLES = "wasted_prev stunted_prev under_prev mean_month median_month"


def located_children(i):
    """Microdata without unit names, cleaned and placed by cluster."""
    return V.survey_working(i.resp.drop(*UNIT), i.clusters, i.nation_edges)


@query("weighted_prevalence", PREVALENCE, doubles=PREVALENCE_DOUBLES, dates="first_month last_month")
def weighted_prevalence(i):
    return V.prevalence(located_children(i))


@query("prevalence_unknown_scores", prevalence_sql(FLAGGED), doubles=PREVALENCE_DOUBLES, dates="first_month last_month")
def prevalence_unknown_scores(i):
    return V.prevalence(flagged(i))


_WAVE_SQL = "CASE year WHEN 1995 THEN '1995MICS' WHEN 1996 THEN '1996MICS' WHEN 1997 THEN '1997MICS' WHEN 1998 THEN '1997MICS' END"
PROGRAMMES = f"""SELECT country AS NAME_0, adm1 AS NAME_1, make_date(year, month, 1) AS ymd, whz2, haz2, waz2, respondents,
    {_WAVE_SQL} AS SurveyId FROM {{surveys_agg}} WHERE MICS = 1
    UNION ALL SELECT country, adm1, make_date(year, month, 1), whz2, haz2, waz2, respondents,
    concat(cast(year AS varchar), 'SMART') FROM {{surveys_agg}} WHERE SMART = 1"""
ROLLUP = f"""SELECT NAME_0, NAME_1, SurveyId, {_rate('whz2', 'respondents')} AS wasted_prev,
    {_rate('haz2', 'respondents')} AS stunted_prev, {_rate('waz2', 'respondents')} AS under_prev,
    {DATES}, sum(respondents) AS n FROM ({PROGRAMMES}) p GROUP BY NAME_0, NAME_1, SurveyId"""


@query("survey_rollup", ROLLUP, doubles=PREVALENCE_DOUBLES + " n", dates="first_month last_month")
def survey_rollup(i):
    return V.programme_prevalence(i.surveys_agg, REGIONS, WAVES)


@query(
    "weighted_mean_na",
    """SELECT NAME_0, NAME_1, ymd,
    CASE WHEN count(*) FILTER (WHERE hc72 IS NULL AND hv005 <> 0) = 0 THEN sum(hc72 * (hv005 / 1e6)) / sum(hv005 / 1e6) END AS wmean_keep,
    sum(hc72 * (hv005 / 1e6)) / nullif(sum(CASE WHEN hc72 IS NOT NULL THEN hv005 / 1e6 END), 0) AS wmean_skip
    FROM {resp} GROUP BY NAME_0, NAME_1, ymd""",
    doubles="wmean_keep wmean_skip",
    dates="ymd",
)
def q_weighted_mean_na(i):
    w = F.col("hv005") / V.WEIGHT_SCALE
    return i.resp.groupBy(*UNIT, "ymd").agg(
        A.weighted_mean_na("hc72", w).alias("wmean_keep"), A.weighted_mean_skip("hc72", w).alias("wmean_skip")
    )


@query(
    "minmax_na",
    """SELECT NAME_0, NAME_1, ymd, cast(CASE WHEN count(hc72) = count(*) THEN min(hc72) END AS double) AS lo,
    cast(CASE WHEN count(hc72) = count(*) THEN max(hc72) END AS double) AS hi,
    CASE WHEN count(hc72) = count(*) THEN avg(hc72) END AS mean FROM {resp} GROUP BY NAME_0, NAME_1, ymd""",
    doubles="lo hi mean",
    dates="ymd",
)
def minmax_na(i):
    x = F.col("hc72").cast("double")
    return i.resp.groupBy(*UNIT, "ymd").agg(
        A.na_min(x).alias("lo"), A.na_max(x).alias("hi"), A.na_avg(x).alias("mean")
    )


@query(
    "date_stats",
    f"SELECT NAME_0, NAME_1, SurveyId, {DATES} FROM {{resp}} GROUP BY ALL",
    doubles="mean_month median_month",
    dates="first_month last_month",
)
def date_stats(i):
    return G.date_stats(i.resp, WAVE, "ymd")


@query(
    "window_date_stats",
    f"""SELECT r.*, s.first_month, s.last_month, s.mean_month, s.median_month FROM
    (SELECT NAME_0, NAME_1, SurveyId, ymd, count(*) AS n FROM {{resp}} GROUP BY ALL) r JOIN
    (SELECT NAME_0, NAME_1, SurveyId, {DATES} FROM (SELECT DISTINCT NAME_0, NAME_1, SurveyId, ymd FROM {{resp}}) d GROUP BY ALL) s
    USING (NAME_0, NAME_1, SurveyId)""",
    doubles="mean_month median_month",
    dates="ymd first_month last_month",
)
def window_date_stats(i):
    return G.attach_date_stats(G.group_count(i.resp, [*WAVE, "ymd"]), WAVE, "ymd")


@query("group_count", "SELECT NAME_0, NAME_1, SurveyId, ymd, count(*) AS n FROM {resp} GROUP BY ALL", dates="ymd")
def group_count(i):
    return G.group_count(i.resp, [*WAVE, "ymd"])


@query(
    "group_mean",
    "SELECT NAME_0, NAME_1, hv000, avg(CASE WHEN hc72 < 9995 THEN hc72 / 1e2 END) AS m FROM {resp} GROUP BY ALL",
    doubles="m",
)
def group_mean(i):
    z = sentinel_null("hc72", at_least=V.FIRST_BAD_CODE) / V.ZSCORE_SCALE
    return i.resp.groupBy(*UNIT, "hv000").agg(F.avg(z).alias("m"))


@query(
    "mean_all",
    "SELECT NAME_0, "
    + ", ".join(
        f"avg({c}) AS {c}"
        for c in ("hc19", "hc18", "CLUSTER", "hc1", "hc72", "hc71", "hc70", "hv005", "hv271", "hc27", "hc61")
    )
    + " FROM {resp} GROUP BY NAME_0",
    doubles="hc19 hc18 CLUSTER hc1 hc72 hc71 hc70 hv005 hv271 hc27 hc61",
)
def mean_all(i):
    return G.mean_all(i.resp, ["NAME_0"])


@query(
    "crosstab",
    "SELECT hc19 AS year, "
    + ", ".join(f"count(*) FILTER (WHERE NAME_0 = '{r}') AS \"{r}\"" for r in REGIONS)
    + " FROM {resp} GROUP BY hc19",
)
def crosstab(i):
    return G.crosstab(i.resp.withColumnRenamed("hc19", "year"), "year", "NAME_0", REGIONS)


@query(
    "ranked_units",
    """SELECT *, cast(row_number() OVER (PARTITION BY NAME_0 ORDER BY m DESC NULLS LAST, NAME_1, hv000) AS int) AS rank FROM
    (SELECT NAME_1, hv000, NAME_0, avg(hc70) AS m FROM {resp} GROUP BY ALL) g""",
    doubles="m",
)
def ranked_units(i):
    return G.ranked_means(i.resp, ["NAME_1", "hv000", "NAME_0"], "hc70", within=["NAME_0"])


@query(
    "wave_lag",
    """SELECT NAME_0, NAME_1, m, m_previous FROM (SELECT *, lag(m, 1) OVER (PARTITION BY NAME_0, NAME_1 ORDER BY year) AS m_previous FROM
    (SELECT NAME_0, NAME_1, hc19 AS year, avg(hc70) AS m FROM {resp} GROUP BY ALL) g) w WHERE year = 1998""",
    doubles="m m_previous",
)
def wave_lag(i):
    waves = G.wave_on_wave(i.resp.withColumnRenamed("hc19", "year"), UNIT, "year", "hc70")
    return waves.where("year = 1998").drop("year")


@query(
    "ordered_output",
    "SELECT NAME_0, NAME_1, SurveyId, count(*) AS n, avg(hc72) AS m FROM {resp} GROUP BY ALL",
    doubles="m",
)
def ordered_output(i):
    table = i.resp.groupBy(*WAVE).agg(F.count(F.lit(1)).alias("n"), F.avg("hc72").alias("m"))
    return table.orderBy(F.asc_nulls_last("NAME_1"), F.asc_nulls_last("SurveyId"))
