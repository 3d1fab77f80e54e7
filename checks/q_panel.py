"""Panels: lags, anomalies, seasons, peaks, carrying forward, covariates, climate."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.q_groups import CHILDREN, PROGRAMMES, REGIONS, WAVES, located_children
from checks.q_tables import CROSSWALK, CROSSWALK_SQL, PANEL, gap_free
from checks.registry import query
from checks.standins import FIRST_MONTH, LAST_MONTH
from panelspark.operators import panel as P
from panelspark.plans import climate as C
from panelspark.plans import covariates as Y
from panelspark.plans import survey as V
from panelspark.plans.survey import UNIT
from panelspark.session import written

VARS = ("rain", "temp", "veg")
# The oracles' own offsets, written out so that a wrong list in the library shows.
BASE = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 24, 36, 48, 60)
SEASON = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 24, 36, 48, 60)
YEARLY = (12, 24, 36, 48, 60)
WIN = "WINDOW w AS (PARTITION BY NAME_0, NAME_1 ORDER BY ymd)"


def lag_cols(var: str, offsets) -> list[str]:
    return [f"lag({var}, {k}) OVER w AS lag_{var}_{k}" for k in offsets]


def names(sql_cols: list[str]) -> list[str]:
    return [c.rsplit(" AS ", 1)[1] for c in sql_cols]


def peak_sql(cols: list[str]) -> str:
    return f"CASE WHEN {' AND '.join(c + ' IS NOT NULL' for c in cols)} THEN greatest({', '.join(cols)}) END"


def avg5_cols(var: str) -> list[str]:
    total = " + ".join(f"lag_{var}_{k}" for k in YEARLY)
    return [f"({total}) / 5 AS {var}_5avg", f"{var} - ({total}) / 5 AS {var}_dev5"]


def roll_cols(var: str) -> list[str]:
    return [
        f"(lag_{var}_{k} + lag_{var}_{k + 1} + lag_{var}_{k + 2}) / 3 AS {var}_mean3_{k}" for k in range(1, 13)
    ]


def season_cols(var: str) -> list[str]:
    return [
        f"{peak_sql([f'{var}_mean3_{k}' for k in range(1, n)])} AS {var}_peak3_{reach}"
        for reach, n in (("12", 11), ("14", 13))
    ]


def tfp_cols(var: str) -> list[str]:
    recent = [f"lag_{var}_{k}" for k in range(1, 15)]
    peak = peak_sql(recent)
    when = " ".join(f"WHEN {c} THEN {n}" for n, c in enumerate(recent, 1))
    return [f"{peak} AS peak_{var}", f"cast(CASE {peak} {when} END AS int) AS tfp_{var}"]


def base_sql(source: str) -> str:
    cols = [c for v in VARS for c in lag_cols(v, BASE)]
    return f"SELECT *, {', '.join(cols)} FROM ({source}) p {WIN}"


def roll_sql(source: str) -> str:
    cols = [c for v in VARS for c in roll_cols(v)]
    return f"SELECT *, {', '.join(cols)} FROM ({base_sql(source)}) b"


def season_sql(source: str) -> str:
    cols = [c for v in VARS for c in season_cols(v)]
    return f"SELECT *, {', '.join(cols)} FROM ({roll_sql(source)}) r"


def season_lag_sql(source: str) -> str:
    cols = [c for v in VARS for c in lag_cols(f"{v}_peak3_14", SEASON)]
    return f"SELECT *, {', '.join(cols)} FROM ({season_sql(source)}) s {WIN}"


def climate_sql(source: str) -> str:
    cols = [c for v in VARS for c in (*avg5_cols(v), *avg5_cols(f"{v}_peak3_14"), *tfp_cols(v))]
    return f"SELECT *, {', '.join(cols)} FROM ({season_lag_sql(source)}) s"


KEYS = ["NAME_0", "NAME_1", "ymd"]
_LAGS = [n for v in VARS for n in names(lag_cols(v, BASE))]
_ROLL = [n for v in VARS for n in names(roll_cols(v))]
_SEAS = [n for v in VARS for n in names(season_cols(v))]
_SLAG = [n for v in VARS for n in names(lag_cols(f"{v}_peak3_14", SEASON))]


def pick(cols: list[str], source: str) -> str:
    return f"SELECT {', '.join([*KEYS, *cols])} FROM ({source}) z"


def based(i):
    return P.lag_panel(gap_free(i), UNIT, "ymd", VARS)


def seasonal(i):
    return P.season_peaks(P.three_month_means(based(i), VARS), VARS)


@query("lag_panel", pick([*VARS, *_LAGS], base_sql(PANEL)), doubles=" ".join([*VARS, *_LAGS]), dates="ymd")
def lag_panel(i):
    return based(i).select(*KEYS, *VARS, *_LAGS)


_ANOM = [n for v in VARS for n in names(avg5_cols(v))]


@query(
    "anomaly_5y",
    f"SELECT {', '.join(KEYS)}, {', '.join(c for v in VARS for c in avg5_cols(v))} FROM ({base_sql(PANEL)}) b",
    doubles=" ".join(_ANOM),
    dates="ymd",
)
def anomaly_5y(i):
    return P.anomalies(based(i), VARS).select(*KEYS, *_ANOM)


@query("roll3", pick(_ROLL, roll_sql(PANEL)), doubles=" ".join(_ROLL), dates="ymd")
def roll3(i):
    return P.three_month_means(based(i), VARS).select(*KEYS, *_ROLL)


@query("season_peak", pick(_SEAS, season_sql(PANEL)), doubles=" ".join(_SEAS), dates="ymd")
def season_peak(i):
    return seasonal(i).select(*KEYS, *_SEAS)


@query("season_lags", pick(_SLAG, season_lag_sql(PANEL)), doubles=" ".join(_SLAG), dates="ymd")
def season_lags(i):
    seasons = [f"{v}_peak3_14" for v in VARS]
    return P.lag_panel(seasonal(i), UNIT, "ymd", seasons, P.SEASON_OFFSETS).select(*KEYS, *_SLAG)


@query(
    "time_from_peak",
    f"SELECT {', '.join(KEYS)}, {', '.join(c for v in VARS for c in tfp_cols(v))} FROM ({base_sql(PANEL)}) b",
    doubles=" ".join(f"peak_{v}" for v in VARS),
    dates="ymd",
)
def time_from_peak(i):
    return P.time_from_peak(based(i), VARS).select(*KEYS, *[f"{p}_{v}" for v in VARS for p in ("peak", "tfp")])


# ---- climate -------------------------------------------------------------------

_RENAMED = f"""SELECT s.NAME_0, s.NAME_1, s.ymd, v.rain, v.temp, v.veg FROM
(SELECT DISTINCT NAME_0, {CROSSWALK_SQL} AS NAME_1, ymd FROM ({PANEL}) a WHERE NAME_0 <> 'EUROPE') s LEFT JOIN
(SELECT NAME_0, {CROSSWALK_SQL} AS NAME_1, ymd, avg(rain) AS rain, avg(temp) AS temp, avg(veg) AS veg FROM {{panel}} GROUP BY 1, 2, 3) v
ON s.NAME_0 = v.NAME_0 AND s.NAME_1 = v.NAME_1 AND s.ymd = v.ymd"""
_CLIM = [
    *VARS, *_LAGS, *_ROLL, *_SEAS, *_SLAG, *_ANOM,
    *[n for v in VARS for n in names(avg5_cols(f"{v}_peak3_14"))], *[f"peak_{v}" for v in VARS],
]
_TFP = [f"tfp_{v}" for v in VARS]


@query("climate_panel", pick([*_CLIM, *_TFP], climate_sql(_RENAMED)), doubles=" ".join(_CLIM), dates="ymd")
def climate_panel(i):
    wanted = [r for r in REGIONS if r != "EUROPE"]
    sources = {v: i.panel.select(*KEYS, v) for v in VARS}
    units = i.unit_names.where(F.col("NAME_0").isin(wanted))
    full = C.climate_panel(sources, wanted, FIRST_MONTH, LAST_MONTH, CROSSWALK, units)
    return full.select(*KEYS, *_CLIM, *_TFP)


def plain_climate(i):
    blank = P.month_skeleton(i.unit_names, UNIT, FIRST_MONTH, LAST_MONTH)
    return P.one_row_per_step(i.panel, UNIT, "ymd", VARS, blank)


INTERVIEWS = f"""SELECT NAME_0, NAME_1, SurveyId, ymd, cast(count(*) AS double) AS n FROM ({CHILDREN}) k GROUP BY ALL
UNION ALL SELECT NAME_0, NAME_1, SurveyId, ymd, sum(respondents) AS n FROM ({PROGRAMMES}) p GROUP BY ALL"""
DAYS = "date_diff('day', DATE '1970-01-01', q.ymd)"


def wmean_sql(c: str, out: str | None = None) -> str:
    return f"CASE WHEN count({c}) = count(*) THEN sum({c} * n) / sum(n) END AS {out or c}"


def ends_sql(c: str) -> list[str]:
    return [f"CASE WHEN count({c}) = count(*) THEN {f}({c}) END AS {c}_{f}" for f in ("min", "max")]


DATE_COLS = f"""min(q.ymd) AS first_month, max(q.ymd) AS last_month, avg({DAYS}) AS mean_month,
    cast(quantile_cont({DAYS}, 0.5) AS double) AS median_month"""
SURVEY_SEASON = [f"lag_{v}_peak3_14_{k}" for v in VARS for k in range(1, 8)]
AT_SURVEY = f"""SELECT q.NAME_0, q.NAME_1, q.SurveyId, {DATE_COLS},
    {', '.join(wmean_sql(c, c + '_mean') for c in _TFP)}, {', '.join(wmean_sql(c) for c in SURVEY_SEASON)},
    {', '.join(e for c in _TFP for e in ends_sql(c))}
    FROM ({INTERVIEWS}) q LEFT JOIN ({climate_sql(PANEL)}) c ON q.NAME_0 = c.NAME_0 AND q.NAME_1 = c.NAME_1 AND q.ymd = c.ymd
    GROUP BY q.NAME_0, q.NAME_1, q.SurveyId"""
AT_SURVEY_DOUBLES = " ".join([*[f"{c}_mean" for c in _TFP], *SURVEY_SEASON])


def interviews(i):
    from panelspark.operators.reshape import stack

    months = [V.wave_months(located_children(i)), V.programme_wave_months(i.surveys_agg, REGIONS, WAVES)]
    # Written as build_panel does: the surveys' joins are not planned again with every panel that meets them.
    return written(V.interview_months(stack(months)), "interviews")[0]


def climate_months(i):
    return C.add_indicators(plain_climate(i), VARS)


@query(
    "climate_at_survey",
    AT_SURVEY,
    doubles=AT_SURVEY_DOUBLES + " mean_month median_month",
    dates="first_month last_month",
)
def climate_at_survey(i):
    return C.climate_at_survey(interviews(i), climate_months(i), VARS)


# ---- yearly covariates ---------------------------------------------------------

_YEARS = range(1994, 2000)


def _year_rows() -> str:
    def col(stem: str, y: int) -> str:
        have = {("lights", y): True for y in range(1995, 1999)} | {("pop", 1995): True, ("pop", 1998): True}
        return f"{stem}_{y}_mean" if (stem, y) in have else "cast(NULL AS double)"

    return " UNION ALL ".join(
        f"SELECT NAME_0, NAME_1, {y} AS year, {col('lights', y)} AS lights, {col('pop', y)} AS pop, access_none_mean AS access FROM {{covariates_wide}}"
        for y in _YEARS
    )


_FILLED = f"""SELECT NAME_0, NAME_1, year, lights, access, last_value(pop IGNORE NULLS) OVER
    (PARTITION BY NAME_0, NAME_1 ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pop FROM ({_year_rows()}) y"""
_LAGGED = f"""SELECT *, {', '.join(f'lag({v}, {k}) OVER w AS {v}_lag{k}' for v in ('lights', 'pop') for k in (1, 2))}
    FROM ({_FILLED}) f WINDOW w AS (PARTITION BY NAME_0, NAME_1 ORDER BY year)"""
_SERIES = {"lights": "lights", "pop": "pop"}
_LAGNAMES = "lights_lag1 lights_lag2 pop_lag1 pop_lag2"


def _long(i):
    return Y.yearly_series(
        i.covariates_wide, UNIT, _SERIES, _YEARS[0], _YEARS[-1], {"access": "access_none_mean"}, "mean"
    )


@query("locf", _FILLED, doubles="lights access pop")
def locf(i):
    return P.carry_forward(_long(i), UNIT, "year", ["pop"])


@query("yearly_lags", _LAGGED, doubles=f"lights access pop {_LAGNAMES}")
def yearly_lags(i):
    return P.yearly_lags(P.carry_forward(_long(i), UNIT, "year", ["pop"]), UNIT, _SERIES | {"pop": "pop"})


@query(
    "yearly_covariates",
    f"""SELECT NAME_0, {CROSSWALK_SQL} AS NAME_1, year, {', '.join(f'avg({c}) AS {c}' for c in f'lights pop access {_LAGNAMES}'.split())}
    FROM ({_LAGGED}) l GROUP BY ALL""",
    doubles=f"lights pop access {_LAGNAMES}",
)
def yearly_covariates(i):
    from panelspark.operators.aggregate import mean_all
    from panelspark.operators.joins import rename_units

    covs = Y.yearly_covariates(
        i.covariates_wide, _SERIES, _YEARS[0], _YEARS[-1], ["pop"], {"access": "access_none_mean"}, "mean"
    )
    return mean_all(rename_units(covs, "NAME_1", CROSSWALK), [*UNIT, "year"])
