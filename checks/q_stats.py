"""Statistics and the end products."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from checks.q_groups import PREVALENCE, PREVALENCE_DOUBLES, REGIONS, ROLLUP, WAVES, located_children
from checks.q_panel import AT_SURVEY, AT_SURVEY_DOUBLES, VARS, climate_months
from checks.q_space import _ECOLS, _EENDS, EVENTS_AT_SURVEY, _ends_as_double, event_panel_lags, parity
from checks.registry import query
from panelspark.operators import stats as T
from panelspark.plans import survey as V
from panelspark.plans.final import build_panel

_Z = "CASE WHEN hc72 < 9995 THEN hc72 / 1e2 END"
GRID = 80


def scored(i):
    """Z-scores, birth interval and birth order as numbers."""
    from panelspark.functions import sentinel_null, text_to_double

    return i.resp.withColumns(
        {
            "z": sentinel_null("hc72", at_least=V.FIRST_BAD_CODE) / V.ZSCORE_SCALE,
            "interval": text_to_double("hc63"),
            "log_interval": F.ln(text_to_double("hc63")),
        }
    )


@query(
    "ols_by_group",
    f"""SELECT NAME_0, hv000, regr_slope({_Z}, hc1) AS slope, regr_intercept({_Z}, hc1) AS intercept, regr_r2({_Z}, hc1) AS r2,
    cast(regr_count({_Z}, hc1) AS bigint) AS n, regr_slope({_Z}, ln(try_cast(hc63 AS double))) AS log_slope FROM {{resp}} GROUP BY NAME_0, hv000""",
    doubles="slope intercept r2 log_slope",
)
def ols_by_group(i):
    keys = ["NAME_0", "hv000"]
    more = [F.regr_slope("z", "log_interval").alias("log_slope")]
    return T.linear_trend(scored(i), keys, "hc1", "z", more)


@query(
    "ols_factor",
    f"""WITH g AS (SELECT NAME_0, hc19 AS year, count(z) AS n, sum(z) AS s, sum(z * z) AS ss FROM (SELECT NAME_0, hc19, {_Z} AS z FROM {{resp}}) r
    WHERE z IS NOT NULL GROUP BY ALL),
    t AS (SELECT *, s / n AS mean, first_value(n) OVER w AS bn, first_value(s / n) OVER w AS bm, year = first_value(year) OVER w AS is_base,
    sum(ss - s * s / n) OVER (PARTITION BY NAME_0) AS rss, sum(n) OVER (PARTITION BY NAME_0) - count(*) OVER (PARTITION BY NAME_0) AS df
    FROM g WINDOW w AS (PARTITION BY NAME_0 ORDER BY year))
    SELECT NAME_0, cast(year AS varchar) AS level, is_base, n, CASE WHEN is_base THEN mean ELSE mean - bm END AS estimate,
    sqrt(rss / df) * sqrt(CASE WHEN is_base THEN 1 / n ELSE 1 / n + 1 / bn END) AS std_error,
    CASE WHEN is_base THEN mean ELSE mean - bm END / (sqrt(rss / df) * sqrt(CASE WHEN is_base THEN 1 / n ELSE 1 / n + 1 / bn END)) AS t_value,
    cast(df AS bigint) AS df FROM t""",
    doubles="estimate std_error t_value",
)
def ols_factor(i):
    return T.one_factor_ols(scored(i).withColumnRenamed("hc19", "year"), "z", "year", ["NAME_0"])


# Normal equations with the response as index 0, swept one term at a time: what is left is the
# inverse, the coefficients and the residual sum.  Tails of t by Simpson's rule.
_TWO_WAY = f"""WITH RECURSIVE cells AS (SELECT cast(hc19 AS varchar) AS f, NAME_1 AS g, cast(count(*) AS double) AS w,
    sum(z) AS sy, sum(z * z) AS yy FROM (SELECT hc19, NAME_1, {_Z} AS z FROM {{resp}}) r
    WHERE z IS NOT NULL AND hc19 IS NOT NULL AND NAME_1 IS NOT NULL GROUP BY ALL),
    x AS (SELECT *, '(Intercept)' AS term FROM cells
    UNION ALL SELECT *, concat('year_', f) FROM cells WHERE f > (SELECT min(f) FROM cells)
    UNION ALL SELECT *, concat('NAME_1_', g) FROM cells WHERE g > (SELECT min(g) FROM cells)),
    terms AS (SELECT term, row_number() OVER (ORDER BY term) AS i FROM x GROUP BY term),
    d AS (SELECT x.*, i FROM x JOIN terms USING (term)),
    known AS (SELECT a.i, b.i AS j, sum(a.w) AS v FROM d a JOIN d b ON a.f = b.f AND a.g = b.g GROUP BY ALL
    UNION ALL SELECT i, 0, sum(sy) FROM d GROUP BY i UNION ALL SELECT 0, i, sum(sy) FROM d GROUP BY i
    UNION ALL SELECT 0, 0, sum(yy) FROM cells),
    size AS (SELECT max(i) AS p, (SELECT sum(w) FROM cells) - max(i) AS df FROM terms),
    sweep AS (SELECT cast(0 AS bigint) AS k, a.i, b.i AS j, coalesce(v, 0e0) AS v
    FROM (SELECT unnest(range((SELECT p + 1 FROM size))) AS i) a CROSS JOIN (SELECT unnest(range((SELECT p + 1 FROM size))) AS i) b
    LEFT JOIN known ON known.i = a.i AND known.j = b.i
    UNION ALL SELECT s.k + 1, s.i, s.j, CASE WHEN s.i = s.k + 1 AND s.j = s.k + 1 THEN 1 / p.v WHEN s.i = s.k + 1 THEN s.v / p.v
    WHEN s.j = s.k + 1 THEN -s.v / p.v ELSE s.v - c.v * r.v / p.v END
    FROM sweep s JOIN sweep p ON p.i = s.k + 1 AND p.j = s.k + 1 JOIN sweep r ON r.i = s.k + 1 AND r.j = s.j
    JOIN sweep c ON c.i = s.i AND c.j = s.k + 1 WHERE s.k < (SELECT p FROM size)),
    done AS (SELECT i, j, v FROM sweep WHERE k = (SELECT p FROM size)),
    fit AS (SELECT term, b.v AS estimate, sqrt(q.v / df * e.v) AS std_error, b.v / sqrt(q.v / df * e.v) AS t_value, df
    FROM terms JOIN done b ON b.i = terms.i AND b.j = 0 JOIN done e ON e.i = terms.i AND e.j = terms.i JOIN done q ON q.i = 0 AND q.j = 0, size),
    steps AS (SELECT s * 1e-2 AS u, CASE WHEN s IN (0, 6000) THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END AS c FROM (SELECT unnest(range(6001)) AS s) r)
    SELECT term, estimate, std_error, t_value, sum(c * power(1 + power(abs(t_value) + u, 2) / df, -(df + 1) / 2))
    / sum(c * power(1 + u * u / df, -(df + 1) / 2)) AS p_value FROM fit, steps GROUP BY ALL"""


@query("ols_two_way", _TWO_WAY, doubles="estimate std_error t_value p_value")
def ols_two_way(i):
    return T.two_factor_ols(scored(i).withColumnRenamed("hc19", "year"), "z", ["year", "NAME_1"])


@query(
    "mixed_moments",
    f"""SELECT year, NAME_1, count(*) AS n, sum(hc1) AS sum_x, sum(z) AS sum_y, sum(hc1 * hc1) AS sum_xx, sum(z * z) AS sum_yy, sum(hc1 * z) AS sum_xy
    FROM (SELECT hc19 AS year, NAME_1, cast(hc1 AS double) AS hc1, {_Z} AS z FROM {{resp}}) r WHERE z IS NOT NULL GROUP BY ALL""",
    doubles="sum_x sum_y sum_xx sum_yy sum_xy",
)
def mixed_moments(i):
    return T.mixed_moments(scored(i).withColumnRenamed("hc19", "year"), ["year", "NAME_1"], "hc1", "z")


@query(
    "histogram_by_group",
    """WITH v AS (SELECT NAME_0, try_cast(hc63 AS double) AS x FROM {resp}),
    w AS (SELECT min(x) AS lo, (max(x) - min(x)) / 29 AS width FROM v),
    o AS (SELECT width, width / 2 + floor((lo - width / 2) / width) * width AS origin FROM w)
    SELECT NAME_0, bin, count(*) AS n, max(origin) + (bin - 0.5e0) * max(width) AS centre FROM
    (SELECT NAME_0, cast(ceil((x - origin) / width) AS int) AS bin, origin, width FROM v, o WHERE x IS NOT NULL) b GROUP BY NAME_0, bin""",
    doubles="centre",
)
def histogram_by_group(i):
    return T.histogram(scored(i), ["NAME_0"], "interval")


@query(
    "kde_by_group",
    f"""WITH v AS (SELECT NAME_0, {_Z} AS x FROM {{resp}} WHERE hc72 < 9995),
    s AS (SELECT NAME_0, count(*) AS n, stddev_samp(x) AS sd, (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34 AS iqr FROM v GROUP BY NAME_0),
    b AS (SELECT NAME_0, n, 0.9 * CASE WHEN least(sd, iqr) > 0 THEN least(sd, iqr) ELSE sd END * power(n, -0.2) AS bw FROM s),
    c AS (SELECT NAME_0, x, count(*) AS w FROM v GROUP BY ALL),
    g AS (SELECT cast(unnest(range({GRID})) AS int) AS grid)
    SELECT c.NAME_0, grid, -5e0 + grid * (9e0 / {GRID - 1}) AS grid_x,
    sum(w * exp(-0.5 * power((-5e0 + grid * (9e0 / {GRID - 1}) - x) / bw, 2))) / (max(n) * max(bw) * {math.sqrt(2 * math.pi)!r}) AS density
    FROM c JOIN b USING (NAME_0) CROSS JOIN g GROUP BY c.NAME_0, grid""",
    doubles="grid_x density",
)
def kde_by_group(i):
    return T.kernel_density(scored(i), ["NAME_0"], "z", -5.0, 4.0, GRID)


_LO, _HI = math.log(12), math.log(61)
_STEP = (_HI - _LO) / (GRID - 1)


@query(
    "local_regression",
    f"""WITH v AS (SELECT NAME_0, ln(try_cast(hc63 AS double)) AS x, {_Z} AS y FROM {{resp}}),
    c AS (SELECT NAME_0, x, count(*) AS w, sum(y) AS sy FROM v WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
    q AS (SELECT NAME_0, floor(sum(w) * 0.75 + 1e-5) AS q FROM c GROUP BY NAME_0),
    g AS (SELECT cast(grid AS int) AS grid, {_LO!r} + grid * {_STEP!r} AS gx FROM (SELECT unnest(range({GRID})) AS grid) r),
    d AS (SELECT c.*, g.grid, g.gx, abs(x - gx) AS d, sum(w) OVER (PARTITION BY c.NAME_0, g.grid ORDER BY abs(x - gx)) AS upto FROM c CROSS JOIN g),
    h AS (SELECT d.NAME_0, d.grid, min(d) AS h FROM d JOIN q USING (NAME_0) WHERE upto >= q GROUP BY ALL),
    k AS (SELECT d.NAME_0, d.grid, gx, w, sy, (x - gx) / h AS t, CASE WHEN abs((x - gx) / h) < 1 THEN power(1 - power(abs((x - gx) / h), 3), 3) ELSE 0 END AS k
    FROM d JOIN h ON d.NAME_0 = h.NAME_0 AND d.grid = h.grid),
    m AS (SELECT NAME_0, grid, gx, {', '.join(f'sum(k * w * power(t, {p})) AS s{p}' for p in range(5))}, {', '.join(f'sum(k * sy * power(t, {p})) AS y{p}' for p in range(3))} FROM k GROUP BY ALL)
    SELECT NAME_0, grid, gx AS grid_x, (y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2))
    / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)) AS fit FROM m""",
    doubles="grid_x fit",
)
def local_regression(i):
    return T.local_regression(scored(i), ["NAME_0"], "log_interval", "z", _LO, _HI, GRID)


# ---- products ------------------------------------------------------------------

_WORK = "SurveyId CLUSTER hc1 hc70 hc71 hc72 whz2 haz2 waz2 ymd LONGNUM LATNUM cc unit_id".split()


@query(
    "survey_working",
    f"""SELECT r.SurveyId, r.CLUSTER, r.hc1, r.hc70 / 1e2 AS hc70, r.hc71 / 1e2 AS hc71, r.hc72 / 1e2 AS hc72,
    cast(hc72 / 1e2 < -2 AS int) AS whz2, cast(hc70 / 1e2 < -2 AS int) AS haz2, cast(hc71 / 1e2 < -2 AS int) AS waz2,
    r.ymd, c.LONGNUM, c.LATNUM, substr(r.SurveyId, 1, 2) AS cc, u.unit_id FROM {{resp}} r
    JOIN {{clusters}} c ON r.SurveyId = c.SurveyId AND r.CLUSTER = c.CLUSTER AND c.LONGNUM IS NOT NULL
    LEFT JOIN ({parity('{clusters}', '{unit_edges}', 'SurveyId, CLUSTER', 'unit_id', 'LONGNUM', 'LATNUM')}) u
    ON r.SurveyId = u.SurveyId AND r.CLUSTER = u.CLUSTER
    WHERE hc1 <= 59 AND hc72 < 9995 AND hc71 < 9995 AND hc70 < 9995""",
    doubles="hc70 hc71 hc72 LONGNUM LATNUM",
    dates="ymd",
)
def survey_working(i):
    return V.survey_working(i.resp, i.clusters, i.unit_edges, ["unit_id"]).select(*_WORK)


FINAL = f"""WITH rates AS (SELECT * REPLACE (cast(n AS double) AS n) FROM ({PREVALENCE}) a UNION ALL SELECT * FROM ({ROLLUP}) b),
    clim AS (SELECT * EXCLUDE (first_month, last_month, mean_month, median_month) FROM ({AT_SURVEY}) c),
    evts AS (SELECT * EXCLUDE (first_month, last_month, mean_month, median_month) FROM ({EVENTS_AT_SURVEY}) e)
    SELECT * FROM (SELECT * FROM rates LEFT JOIN clim USING (NAME_0, NAME_1, SurveyId)) x FULL JOIN evts USING (NAME_0, NAME_1, SurveyId)"""
_TFP_ENDS = " ".join(f"tfp_{v}_{e}" for v in VARS for e in ("min", "max"))


def final_table(i):
    return _ends_as_double(
        build_panel(
            located_children(i), i.surveys_agg, climate_months(i), VARS, event_panel_lags(i), REGIONS, WAVES
        )
    )


@query(
    "final_panel",
    FINAL,
    doubles=f"{PREVALENCE_DOUBLES} n {AT_SURVEY_DOUBLES} {_TFP_ENDS} {' '.join(_ECOLS)} {_EENDS}",
    dates="first_month last_month",
)
def final_panel(i):
    return final_table(i)
