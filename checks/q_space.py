"""Points, grids, rasters and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.q_panel import DATE_COLS, INTERVIEWS, ends_sql, interviews, wmean_sql
from checks.registry import query
from checks.standins import FIRST_MONTH, LAST_MONTH
from panelspark.functions import month_from_file_name
from panelspark.functions.dates import MONTH_NAMES
from panelspark.operators import events as E
from panelspark.operators import spatial as S
from panelspark.plans import conflict as X
from panelspark.plans import covariates as Y
from panelspark.plans import survey as V
from panelspark.plans.raster import raster_panel, read_raster_folder
from panelspark.plans.survey import UNIT
from panelspark.session import scratch_path
from panelspark.sources import files

LEVELS = ["Level_1", "Level_2", "Level_3", "Level_4_text"]
FEEDS = ["A", "B", "C"]


def parity(points: str, edges: str, pid: str, unit: str, x: str, y: str, exact: bool = True) -> str:
    """Pairs of points and the units they lie in or on.

    Doubles between 2 ** -6 and 4 are whole multiples of 2 ** -58: in 128-bit integers every
    product of differences is exact.  Metres do not fit and are compared as doubles, off the borders.
    """

    def of(c: str) -> str:
        return f"cast({c} * 288230376151711744e0 AS hugeint)" if exact else c

    side = f"({of('u.x2')} - {of('u.x1')}) * ({of(f'e.{y}')} - {of('u.y1')}) - ({of('u.y2')} - {of('u.y1')}) * ({of(f'e.{x}')} - {of('u.x1')})"
    near = f"e.{x} BETWEEN least(u.x1, u.x2) AND greatest(u.x1, u.x2) AND e.{y} BETWEEN least(u.y1, u.y2) AND greatest(u.y1, u.y2)"
    return f"""SELECT {pid}, {unit} FROM (SELECT {pid}, {unit}, u.y1 > e.{y} AS above1, u.y2 > e.{y} AS above2, {side} AS side, {near} AS near
        FROM {points} e CROSS JOIN {edges} u) x GROUP BY {pid}, {unit}
    HAVING bool_or(near AND side = 0) OR count(*) FILTER (above1 <> above2 AND (side > 0) = above2 AND side <> 0) % 2 = 1"""


@query("points_in_units", parity("{evt}", "{unit_edges}", "event_id", "unit_id", "longitude", "latitude"))
def points_in_units(i):
    return S.assign_units(i.evt, i.unit_edges, how="inner").select("event_id", "unit_id")


@query("border_points", parity("{border_points}", "{sloped_edges}", "event_id", "unit_id", "longitude", "latitude"))
def border_points(i):
    return S.assign_units(i.border_points, i.sloped_edges, how="inner").select("event_id", "unit_id")


_SIDES = [
    f"((u.x2 - u.x1) * (b.{y} - u.y1) - (u.y2 - u.y1) * (b.{x} - u.x1))" for x in ("xmin", "xmax") for y in ("ymin", "ymax")
]
BOXES = f"""SELECT DISTINCT b.gid, u.unit_id FROM {{grid}} b CROSS JOIN {{unit_edges}} u
    WHERE greatest(u.x1, u.x2) >= b.xmin AND least(u.x1, u.x2) <= b.xmax AND greatest(u.y1, u.y2) >= b.ymin
    AND least(u.y1, u.y2) <= b.ymax AND NOT (least({', '.join(_SIDES)}) > 0 OR greatest({', '.join(_SIDES)}) < 0)
    UNION {parity('{grid}', '{unit_edges}', 'gid', 'unit_id', 'xmin', 'ymin')}"""


@query("grid_to_units", BOXES)
def grid_to_units(i):
    return S.box_units(i.grid, i.unit_edges, "gid")


_GRID_MEANS = f"""SELECT unit_id, year, avg(pop) AS pop, avg(nlights) AS nlights, avg(col) AS col, avg(row) AS row, avg(ttime) AS ttime
    FROM ({BOXES}) p JOIN {{grid_yearly}} y ON p.gid = y.gid JOIN {{grid}} g ON p.gid = g.gid GROUP BY unit_id, year"""
_GRID_FILLED = f"""SELECT unit_id, year, col, row, ttime, last_value(pop IGNORE NULLS) OVER w AS pop, last_value(nlights IGNORE NULLS) OVER w AS nlights
    FROM ({_GRID_MEANS}) m WINDOW w AS (PARTITION BY unit_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _whole(c: str) -> str:
    return f"cast({c} * 288230376151711744e0 AS hugeint)"


def _side(x1: str, y1: str, x2: str, y2: str, px: str, py: str) -> str:
    return f"sign(({_whole(x2)} - {_whole(x1)}) * ({_whole(py)} - {_whole(y1)}) - ({_whole(y2)} - {_whole(y1)}) * ({_whole(px)} - {_whole(x1)}))"


_ENDS_A, _ENDS_B = ("a.x1", "a.y1", "a.x2", "a.y2"), ("b.x1", "b.y1", "b.x2", "b.y2")
POLYGONS = f"""SELECT gid, unit_id FROM {{diamonds}} a CROSS JOIN {{unit_edges}} b
    WHERE greatest(a.x1, a.x2) >= least(b.x1, b.x2) AND greatest(b.x1, b.x2) >= least(a.x1, a.x2)
    AND greatest(a.y1, a.y2) >= least(b.y1, b.y2) AND greatest(b.y1, b.y2) >= least(a.y1, a.y2)
    AND {_side(*_ENDS_A, 'b.x1', 'b.y1')} * {_side(*_ENDS_A, 'b.x2', 'b.y2')} <= 0
    AND {_side(*_ENDS_B, 'a.x1', 'a.y1')} * {_side(*_ENDS_B, 'a.x2', 'a.y2')} <= 0
    UNION SELECT gid, unit_id FROM ({parity('(SELECT gid, x1 AS px, y1 AS py FROM {diamonds})', '{unit_edges}', 'gid, px, py', 'unit_id', 'px', 'py')}) p
    UNION SELECT gid, unit_id FROM ({parity('(SELECT unit_id AS uid, x1 AS px, y1 AS py FROM {unit_edges})', '(SELECT gid AS cell, x1, y1, x2, y2 FROM {diamonds})', 'uid, px, py', 'cell', 'px', 'py')}) q(unit_id, px, py, gid)"""


@query("polygon_pairs", POLYGONS)
def polygon_pairs(i):
    return S.polygon_pairs(i.diamonds, i.unit_edges, ["gid"], ["unit_id"])


@query(
    "carry_years",
    f"""WITH f AS ({_GRID_FILLED}) SELECT unit_id, cast(year + 1 AS int) AS year, pop, nlights, col, row, ttime FROM
    (SELECT * FROM f UNION ALL SELECT * REPLACE (2002 AS year) FROM f WHERE year = 2001
     UNION ALL SELECT * REPLACE (2003 AS year) FROM f WHERE year = 2001) z""",
    doubles="pop nlights col row ttime",
)
def carry_years(i):
    static = i.grid.select("gid", "col", "row", "ttime")
    return Y.grid_covariates(
        i.grid, static, i.grid_yearly, i.unit_edges, ["pop", "nlights"], 2001, [2002, 2003], ["unit_id"]
    )


# Band b of the rasters is the b-th month from January 1995.
_BAND_MONTH = "cast(DATE '1995-01-01' + to_months(band) AS date)"
_LOCATED = parity("(SELECT DISTINCT cell_id, x, y FROM {cells_long})", "{unit_edges}", "cell_id", "unit_id", "x", "y")
ZONAL = f"""SELECT u.unit_id, {_BAND_MONTH} AS ymd, avg(CASE WHEN value <> -9999 THEN value END) AS value
    FROM ({_LOCATED}) u JOIN {{cells_long}} c ON u.cell_id = c.cell_id GROUP BY u.unit_id, band"""


def _bands(i) -> DataFrame:
    """Step of each band position: one row per band of the raster stack."""
    n = i.cells.select(F.max(F.size("bands"))).first()[0]
    return i.spark.range(n).select(
        F.col("id").cast("int").alias("band"), F.expr("add_months(DATE '1995-01-01', cast(id AS int))").alias("ymd")
    )


def zonal(i) -> DataFrame:
    means = S.zonal_mean(i.cells, i.unit_edges, value="bands", bands=_bands(i))
    return means.select("unit_id", "ymd", F.col("bands").alias("value"))


def _cell_files(i) -> DataFrame:
    """Cells with the file they come from: named by month word and year, listing order means nothing."""
    month = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.col("band") % 12 + 1)
    year = F.lit(1995) + F.floor(F.col("band") / 12)
    return i.cells_long.withColumn("file", F.concat(F.lit("tmax."), month, F.lit("."), year, F.lit(".tif")))


@query("raster_folder", f"SELECT * FROM ({ZONAL}) z WHERE year(ymd) IN (1996, 1998)", doubles="value", dates="ymd")
def raster_folder(i):
    """Writes one folder of cells per month and reads two years of them back."""
    path = scratch_path(i.spark, "raster_folder")
    named = _cell_files(i).withColumn("file", F.regexp_replace("file", r"\\.tif$", ""))
    named.select("file", "cell_id", "x", "y", "value").write.partitionBy("file").csv(path, header=True)
    cells = read_raster_folder(i.spark, path, "tmax.", "cell_id long, x double, y double, value double", [1996, 1998])
    return raster_panel(cells, i.unit_edges, ["unit_id"])


@query("raster_panel", ZONAL, doubles="value", dates="ymd")
def raster_by_file(i):
    return raster_panel(_cell_files(i), i.unit_edges, ["unit_id"], file_name="file")


def _metres(x: str, y: str) -> str:
    return f"6371007.181e0 * ({x} * (pi() / 180)) * cos({y} * (pi() / 180)) AS {x}, 6371007.181e0 * ({y} * (pi() / 180)) AS {y}"


# Cells lie on the metre grid, so the boundaries have to be moved to it.
_MOVED = parity(
    f"(SELECT DISTINCT cell_id, {_metres('x', 'y')} FROM {{cells_long}})",
    f"(SELECT unit_id, {_metres('x1', 'y1')}, {_metres('x2', 'y2')} FROM {{unit_edges}})",
    "cell_id", "unit_id", "x", "y", exact=False,
)


@query("raster_panel_projected", ZONAL.replace(_LOCATED, _MOVED), doubles="value", dates="ymd")
def raster_projected(i):
    cells = S.to_sinusoidal(_cell_files(i), [("x", "y")])
    return raster_panel(cells, i.unit_edges, ["unit_id"], file_name="file", sinusoidal=True, tile=25_000.0)


@query("zonal_mean", ZONAL, doubles="value", dates="ymd")
def zonal_mean(i):
    return zonal(i)


@query(
    "climatology",
    f"SELECT unit_id, cast(month(ymd) AS int) AS month, CASE WHEN count(value) = count(*) THEN avg(value) END AS value FROM ({ZONAL}) z GROUP BY ALL",
    doubles="value",
)
def climatology(i):
    return S.climatology(zonal(i), ["unit_id"])


@query(
    "alpha_months",
    f"SELECT cell_id, {_BAND_MONTH} AS ymd, value FROM {{cells_long}}",
    doubles="value",
    dates="ymd",
)
def alpha_months(i):
    return _cell_files(i).select("cell_id", month_from_file_name("file").alias("ymd"), "value")


@query(
    "sinusoidal",
    """SELECT cell_id, 6371007.181e0 * (x * (pi() / 180)) * cos(y * (pi() / 180)) AS x, 6371007.181e0 * (y * (pi() / 180)) AS y
    FROM (SELECT DISTINCT cell_id, x, y FROM {cells_long}) c""",
    doubles="x y",
)
def sinusoidal(i):
    return S.to_sinusoidal(i.cells.select("cell_id", "x", "y"), [("x", "y")])


# ---- events --------------------------------------------------------------------


@query(
    "event_harmonize",
    """SELECT event_id, dataset, CASE WHEN base_category = 'view' AND fatalities > 0 THEN 'Riots'
    WHEN base_category = 'view' AND fatalities < 1 THEN 'Protests' ELSE base_category END AS base_category,
    date, enddate, longitude, latitude FROM {evt}""",
    doubles="longitude latitude",
    dates="date enddate",
)
def event_harmonize(i):
    def feed(dataset: str, fmt: str) -> DataFrame:
        """The source's own table: text dates in its format."""
        return i.evt.where(F.col("dataset") == dataset).withColumns(
            {"start": F.date_format("date", fmt), "stop": F.date_format("enddate", fmt)}
        )

    split = E.split_by_measure("base_category", "fatalities", "view", "Riots", "Protests")
    formats = {"A": "dd/MM/yyyy", "B": "yyyy-MM-dd", "C": "dd-MMM-yy"}
    parts = [
        E.harmonise(
            feed(d, fmt), d, split if d == "A" else "base_category", "start", "longitude", "latitude",
            None if d == "A" else "stop", fmt,
        )
        for d, fmt in formats.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "feeds_from_files",
    """SELECT event_id, dataset, CASE WHEN base_category = 'view' AND fatalities > 0 THEN 'Riots'
    WHEN base_category = 'view' AND fatalities < 1 THEN 'Protests' ELSE base_category END AS base_category,
    date, CASE WHEN dataset <> 'A' THEN enddate END AS enddate, longitude, latitude FROM {evt}""",
    doubles="longitude latitude",
    dates="date enddate",
)
def feeds_from_files(i):
    """Three feeds, each a folder of CSV files in its own columns, date form and order of columns."""
    at = {d: scratch_path(i.spark, f"feed-{d}") for d in FEEDS}
    evt = i.evt.withColumns({"longitude": F.col("longitude").cast("string"), "latitude": F.col("latitude").cast("string")})
    evt.where("dataset = 'A'").select(
        F.date_format("date", "dd/MM/yyyy").alias("EVENT_DATE"), F.col("base_category").alias("EVENT_TYPE"),
        F.col("fatalities").alias("FATALITIES"), F.col("latitude").alias("LATITUDE"), F.col("longitude").alias("LONGITUDE"),
        F.col("event_id").alias("EVENT_ID"), F.lit("a note, quoted").alias("NOTES"),
    ).write.csv(at["A"], header=True)
    evt.where("dataset = 'B'").select(
        F.col("event_id").alias("id"), F.col("base_category").alias("type_of_violence"), "date", F.col("enddate").alias("date_end"), "latitude", "longitude",
    ).withColumnRenamed("date", "date_start").write.csv(at["B"], header=True)
    evt.where("dataset = 'C'").select(
        F.col("event_id").alias("eventid"), F.date_format("date", "dd-MMM-yy").alias("startdate"), F.date_format("enddate", "dd-MMM-yy").alias("enddate"),
        F.col("base_category").alias("etype"), "longitude", "latitude",
    ).write.csv(at["C"], header=True, nullValue="NA")
    a = files.read_csv(i.spark, at["A"], "EVENT_DATE string, EVENT_TYPE string, FATALITIES long, LATITUDE double, LONGITUDE double, EVENT_ID long, NOTES string")
    b = files.read_csv(i.spark, at["B"], "id long, type_of_violence string, date_start string, date_end string, latitude double, longitude double")
    c = files.read_csv(i.spark, at["C"], "eventid long, startdate string, enddate string, etype string, longitude double, latitude double")
    split = E.split_by_measure("EVENT_TYPE", "FATALITIES", "view", "Riots", "Protests")
    parts = [
        E.harmonise(a, "A", split, "EVENT_DATE", "LONGITUDE", "LATITUDE", None, "dd/MM/yyyy", "EVENT_ID"),
        E.harmonise(b, "B", "type_of_violence", "date_start", "longitude", "latitude", "date_end", "yyyy-MM-dd", "id"),
        E.harmonise(c, "C", "etype", "startdate", "longitude", "latitude", "enddate", "dd-MMM-yy", "eventid"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "taxonomy_split",
    """SELECT event_id, CASE WHEN base_category = 'view' AND fatalities > 0 THEN 'Riots'
    WHEN base_category = 'view' AND fatalities < 1 THEN 'Protests' ELSE base_category END AS event_tax FROM {evt}""",
)
def taxonomy_split(i):
    tax = E.split_by_measure("base_category", "fatalities", "view", "Riots", "Protests")
    return i.evt.select("event_id", tax.alias("event_tax"))


@query(
    "taxonomy_lookup",
    f"SELECT e.event_id, e.dataset, e.base_category, {', '.join(LEVELS)} FROM {{evt}} e LEFT JOIN {{taxonomy}} t USING (dataset, base_category)",
)
def taxonomy_lookup(i):
    return E.classify(i.evt, i.taxonomy).select("event_id", "dataset", "base_category", *LEVELS)


# ---- event integration ---------------------------------------------------------


def dedupe_sql(events: str, rounds: int = 14) -> str:
    """The matching of ``integrate`` as plain SQL, rounds unrolled."""
    site = "dataset, base_category, date, enddate, longitude, latitude"
    apart = " + ".join(f"CASE WHEN a.{c} = b.{c} THEN 0 ELSE 1 END" for c in LEVELS)
    km = """2 * 6371.0088e0 * asin(sqrt(power(sin((radians(b.latitude) - radians(a.latitude)) / 2), 2)
        + cos(radians(a.latitude)) * cos(radians(b.latitude)) * power(sin(radians(b.longitude - a.longitude) / 2), 2)))"""
    out = [
        f"copies AS MATERIALIZED (SELECT event_id, struct_pack(id := min(event_id) OVER (PARTITION BY {site}), feed := dataset) AS site, "
        f"row_number() OVER (PARTITION BY {site} ORDER BY substr(md5(cast(event_id AS varchar)), 1, 3), event_id) AS rnk, "
        f"count(*) OVER (PARTITION BY {site}) AS n, {site} FROM {events})",
        f"sites AS MATERIALIZED (SELECT c.*, {', '.join(LEVELS)} FROM copies c LEFT JOIN {{taxonomy}} t USING (dataset, base_category) WHERE rnk = 1)",
        "kept_0 AS (SELECT *, n AS free, 0 AS used FROM sites WHERE dataset = 'A')",
    ]
    for step, source in enumerate(("B", "C")):
        out += [
            f"in_{step} AS (SELECT *, n AS free, 0 AS used FROM sites WHERE dataset = '{source}')",
            f"""p_{step}_0 AS MATERIALIZED (SELECT * FROM (SELECT a.site AS sa, b.site AS sb, {apart} AS lv, cast(round({km} * 1000) AS bigint) AS m, {km} AS km,
            abs(date_diff('day', a.date, b.date)) AS d, a.free AS fa, b.free AS fb, a.used AS ua, b.used AS ub
            FROM kept_{step} a JOIN in_{step} b ON a.date BETWEEN b.date - 2 AND b.date + 2
            AND abs(a.longitude - b.longitude) < 0.05 AND abs(a.latitude - b.latitude) < 0.05
            AND ((a.enddate IS NULL AND b.enddate IS NULL) OR abs(date_diff('day', a.enddate, b.enddate)) <= 2)) x WHERE km <= 4 AND lv < 4)""",
        ]
        for r in range(rounds):
            out += [
                f"""w_{step}_{r} AS MATERIALIZED (SELECT sa, sb, ua, ub, least(fa, fb) AS q FROM (SELECT *,
                row_number() OVER (PARTITION BY sa ORDER BY lv, m, d, sb) AS ra, row_number() OVER (PARTITION BY sb ORDER BY lv, m, d, sa) AS rb
                FROM p_{step}_{r}) x WHERE ra = 1 AND rb = 1)""",
                f"""p_{step}_{r + 1} AS MATERIALIZED (SELECT p.* REPLACE (p.fa - coalesce(a.q, 0) AS fa, p.fb - coalesce(b.q, 0) AS fb,
                p.ua + coalesce(a.q, 0) AS ua, p.ub + coalesce(b.q, 0) AS ub) FROM p_{step}_{r} p LEFT JOIN w_{step}_{r} a ON p.sa = a.sa
                LEFT JOIN w_{step}_{r} b ON p.sb = b.sb WHERE p.fa > coalesce(a.q, 0) AND p.fb > coalesce(b.q, 0))""",
            ]
        won = " UNION ALL ".join(f"SELECT sa, sb, q, ua, ub FROM w_{step}_{r}" for r in range(rounds))
        out += [
            f"links_{step} AS MATERIALIZED ({won})",
            f"""kept_{step + 1} AS MATERIALIZED (SELECT * FROM kept_{step} UNION ALL SELECT i.* REPLACE (i.free - coalesce(s.q, 0) AS free, coalesce(s.q, 0) AS used)
            FROM in_{step} i LEFT JOIN (SELECT sb, sum(q) AS q FROM links_{step} GROUP BY sb) s ON i.site = s.sb WHERE i.free > coalesce(s.q, 0))""",
        ]
    return (
        "WITH "
        + ",\n".join(out)
        + f""" SELECT c.event_id, c.dataset, c.base_category, c.date, c.enddate,
        c.longitude, c.latitude, cast(a.event_id AS bigint) AS duplicate_of, a.dataset AS duplicate_of_dataset FROM copies c
        LEFT JOIN (SELECT * FROM links_0 UNION ALL SELECT * FROM links_1) l ON c.site = l.sb AND c.rnk > l.ub AND c.rnk <= l.ub + l.q
        LEFT JOIN copies a ON a.site = l.sa AND a.rnk = c.rnk - l.ub + l.ua"""
    )


@query("event_dedupe", dedupe_sql("{evt_town}"), doubles="longitude latitude", dates="date enddate")
def event_dedupe(i):
    merged = E.integrate(i.evt_town, i.taxonomy, FEEDS, LEVELS)
    return merged.select("event_id", *E.SITE, "duplicate_of", "duplicate_of_dataset")


UNIQUE = f"""SELECT event_id, dataset, base_category, date, enddate, longitude, latitude
    FROM ({dedupe_sql("{evt_months}")}) m WHERE duplicate_of IS NULL"""


@query("unique_events", UNIQUE, doubles="longitude latitude", dates="date enddate")
def unique_events(i):
    return E.unique_events(E.integrate(i.evt_months, i.taxonomy, FEEDS, LEVELS))


# ---- counts of unique events ---------------------------------------------------

POINTS = f"""SELECT date, latitude, longitude, count(*) AS events FROM ({UNIQUE}) e JOIN {{taxonomy}} t USING (dataset, base_category)
    WHERE Level_4_text = 'Violent Event' AND latitude IS NOT NULL GROUP BY date, latitude, longitude"""
_BOX_JOIN = "p.longitude > b.xa AND p.longitude < b.xb AND p.latitude > b.ya AND p.latitude < b.yb"
COUNTS = f"""SELECT b.NAME_0, b.NAME_1, cast(date_trunc('month', p.date) AS date) AS ymd, count(*) AS violent_events,
    cast(sum(events) AS bigint) AS n_events FROM ({POINTS}) p JOIN {{nation_box}} b ON {_BOX_JOIN} GROUP BY ALL"""
MONTHS = f"(SELECT cast(unnest(generate_series(DATE '{FIRST_MONTH}', DATE '{LAST_MONTH}', INTERVAL 1 MONTH)) AS date) AS ymd)"
EVENT_PANEL = f"""SELECT s.NAME_0, s.NAME_1, s.ymd, coalesce(c.violent_events, 0) AS violent_events FROM
    (SELECT NAME_0, NAME_1, ymd FROM {{nation_box}} CROSS JOIN {MONTHS} m) s LEFT JOIN ({COUNTS}) c
    ON s.NAME_0 = c.NAME_0 AND s.NAME_1 = c.NAME_1 AND s.ymd = c.ymd"""
_ELAGS = [f"lag_violent_events_{k}" for k in range(1, 37)]
EVENT_LAGS = f"""SELECT *, {', '.join(f'lag(violent_events, {k}) OVER w AS lag_violent_events_{k}' for k in range(1, 37))}
    FROM ({EVENT_PANEL}) p WINDOW w AS (PARTITION BY NAME_0, NAME_1 ORDER BY ymd)"""


def classified(i):
    return X.integrated_events(i.evt_months, i.taxonomy, FEEDS, LEVELS)


def violent_points(i):
    return E.location_days(classified(i), F.col("Level_4_text") == "Violent Event")


def event_panel_lags(i):
    return X.event_panel(classified(i), i.nation_edges, FIRST_MONTH, LAST_MONTH)


@query("event_points", POINTS, doubles="latitude longitude", dates="date")
def event_points(i):
    return violent_points(i)


@query("event_counts", COUNTS, dates="ymd")
def event_counts(i):
    return X.event_counts(S.assign_units(violent_points(i), i.nation_edges, UNIT))


@query("event_panel", EVENT_PANEL, dates="ymd")
def event_panel(i):
    located = S.assign_units(violent_points(i), i.nation_edges, UNIT, how="inner")
    return X.zero_filled_counts(located, i.nation_edges, FIRST_MONTH, LAST_MONTH)


@query(
    "event_lags",
    "SELECT NAME_0, NAME_1, ymd, violent_events, "
    + ", ".join(f"cast({c} AS double) AS {c}" for c in _ELAGS)
    + f" FROM ({EVENT_LAGS}) l",
    doubles=" ".join(_ELAGS),
    dates="ymd",
)
def event_lags(i):
    lagged = event_panel_lags(i)
    return lagged.select(*UNIT, "ymd", "violent_events", *[F.col(c).cast("double") for c in _ELAGS])


_ECOLS = ["violent_events", *_ELAGS[:24]]
EVENTS_AT_SURVEY = f"""SELECT q.NAME_0, q.NAME_1, q.SurveyId, {DATE_COLS}, {', '.join(wmean_sql(c) for c in _ECOLS)},
    {', '.join(e for c in _ECOLS for e in ends_sql(c))} FROM ({INTERVIEWS}) q LEFT JOIN ({EVENT_LAGS}) c
    ON q.NAME_0 = c.NAME_0 AND q.NAME_1 = c.NAME_1 AND q.ymd = c.ymd GROUP BY q.NAME_0, q.NAME_1, q.SurveyId"""


def event_waves(i):
    return X.events_at_survey(interviews(i), event_panel_lags(i))


def _ends_as_double(df: DataFrame) -> DataFrame:
    """Counts that may be missing print as doubles in both engines."""
    ends = [c for c in df.columns if c.endswith(("_min", "_max"))]
    return df.withColumns({c: F.col(c).cast("double") for c in ends})


_EENDS = " ".join(f"{c}_{e}" for c in _ECOLS for e in ("min", "max"))


@query(
    "events_at_survey",
    EVENTS_AT_SURVEY,
    doubles=" ".join(_ECOLS) + f" {_EENDS} mean_month median_month",
    dates="first_month last_month",
)
def events_at_survey(i):
    return _ends_as_double(event_waves(i))
