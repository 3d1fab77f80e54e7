"""Stand-ins for the survey, climate, event and boundary inputs.

Each is SQL over the given tables, the same text for Spark and the oracle engine
(a pair where the dialects differ).  ``{name}`` marks a dependency.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from panelspark.operators.joins import shuffled

BASE = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events",
        "documents", "embeddings", "part")
FIRST_MONTH, LAST_MONTH = "1995-01-01", "2001-11-01"
# Tables that stand-ins look records up in by a key that grows with the input: never gathered in the driver.
MOVED = {"resp": ("orders", "customer"), "panel": ("orders", "customer"), "covariates_wide": ("customer",)}

_SQL: dict[str, str | tuple[str, str]] = {}
_SCHEMAS: dict = {}  # footers are read once per table

_SQL["resp"] = """
SELECT r.r_name AS NAME_0, n.n_name AS NAME_1,
       concat(substr(r.r_name, 1, 2), cast(year(o.o_orderdate) AS string)) AS SurveyId,
       concat(substr(r.r_name, 1, 2), cast(year(o.o_orderdate) % 10 AS string)) AS hv000,
       cast(date_trunc('month', o.o_orderdate) AS date) AS ymd,
       cast(year(o.o_orderdate) AS int) AS hc19, cast(month(o.o_orderdate) AS int) AS hc18,
       cast(o.o_custkey % 40 AS int) AS CLUSTER,
       cast((l.l_orderkey * 7 + l.l_linenumber * 13) % 72 AS int) AS hc1,
       CASE WHEN l.l_partkey % 97 = 0 THEN 9998 WHEN l.l_partkey % 89 = 0 THEN NULL
            ELSE cast((l.l_partkey * 31 + l.l_orderkey * 17 + l.l_linenumber * 53) % 900 AS int) - 500 END AS hc72,
       CASE WHEN l.l_suppkey % 61 = 0 THEN 9997
            ELSE cast((l.l_partkey * 13 + l.l_orderkey * 29) % 900 AS int) - 500 END AS hc71,
       cast((l.l_partkey * 7 + l.l_orderkey * 3 + l.l_linenumber) % 900 AS int) - 500 AS hc70,
       cast(l.l_quantity AS bigint) * 1000000 AS hv005,
       l.l_extendedprice AS hv271,
       CASE l.l_partkey % 7 WHEN 0 THEN 'poorest' WHEN 1 THEN 'lowest' WHEN 2 THEN 'second'
            WHEN 3 THEN 'middle' WHEN 4 THEN 'richer' WHEN 5 THEN 'highest' END AS hv270,
       CASE WHEN l.l_orderkey % 11 = 0 THEN 'missing' ELSE cast(12 + l.l_orderkey % 50 AS string) END AS hc63,
       CASE WHEN l.l_partkey % 13 = 0 THEN 'missing' ELSE cast(1 + l.l_partkey % 9 AS string) END AS hc64,
       CASE l.l_suppkey % 7 WHEN 0 THEN 'on premises' WHEN 1 THEN 'don''t know' WHEN 2 THEN 'missing'
            WHEN 3 THEN 'more than 12 hours' WHEN 4 THEN '995+'
            ELSE cast(l.l_orderkey % 90 AS string) END AS hv204,
       cast(l.l_linenumber % 4 AS int) AS hc27, cast(l.l_partkey % 5 AS int) AS hc61
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

# Month values per unit; months in which a unit has no record are gaps.
_SQL["panel"] = """
SELECT NAME_0, NAME_1, ymd,
       cast(CASE WHEN (nk * 5 + month(ymd)) % 37 = 0 THEN NULL
                 ELSE qty % 1000 + (nk * 17 + month(ymd) * 29) % 101 END AS double) AS rain,
       cast(disc % 100 + (nk * 7 + month(ymd) * 3 + year(ymd)) % 13 AS double) AS temp,
       cast((qty + disc * 3) % 97 AS double) AS veg
FROM (SELECT r.r_name AS NAME_0, n.n_name AS NAME_1, n.n_nationkey AS nk,
             cast(date_trunc('month', l.l_shipdate) AS date) AS ymd,
             cast(sum(cast(l.l_quantity AS bigint)) AS bigint) AS qty,
             cast(sum(cast(round(l.l_discount * 100) AS bigint)) AS bigint) AS disc
      FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
      JOIN {customer} c ON o.o_custkey = c.c_custkey
      JOIN {nation} n ON c.c_nationkey = n.n_nationkey
      JOIN {region} r ON n.n_regionkey = r.r_regionkey
      GROUP BY r.r_name, n.n_name, n.n_nationkey, cast(date_trunc('month', l.l_shipdate) AS date)) g
"""

_SQL["unit_names"] = """
SELECT r_name AS NAME_0, n_name AS NAME_1, n_nationkey AS UniqueID,
       concat(r_name, '_', replace(n_name, '_', ' ')) AS ID_LINK1, n_name AS ADMIN
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

_SQL["evt"] = """
SELECT event_id,
       CASE WHEN event_type IN ('click', 'view') THEN 'A'
            WHEN event_type IN ('purchase', 'signup') THEN 'B' ELSE 'C' END AS dataset,
       event_type AS base_category, cast(ts AS date) AS date,
       CASE WHEN event_type NOT IN ('click', 'view') AND event_id % 20 = 0
            THEN cast(ts AS date) + cast(1 + event_id % 3 AS int) END AS enddate,
       ((event_id * event_id * 37 + event_id * 11) % 101) / 5e1 AS longitude,
       ((event_id * event_id * 53 + event_id * 91) % 103) / 5e1 AS latitude,
       cast(floor(value) AS bigint) % 5 AS fatalities
FROM {events}
"""

# A third of all events are geocoded to one town.  Every feed numbers its entries on its own,
# so most ids occur in several feeds.
_OWN_ID = "event_id + CASE dataset WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END"
_SQL["evt_town"] = f"""
SELECT {_OWN_ID} AS event_id, dataset, base_category, date, enddate,
       CASE WHEN event_id % 3 = 0 THEN 1e0 ELSE longitude END AS longitude,
       CASE WHEN event_id % 3 = 0 THEN 1e0 ELSE latitude END AS latitude
FROM {{evt}}
"""

# The same events spread over the months of the survey period.
_SQL["evt_months"] = f"""
SELECT {_OWN_ID} AS event_id, dataset, base_category, fatalities,
       DATE '1995-01-01' + cast((event_id * 7919) % 2500 AS int) AS date,
       CASE WHEN enddate IS NOT NULL THEN DATE '1995-01-01' + cast((event_id * 7919) % 2500 + 1 + event_id % 3 AS int) END AS enddate,
       CASE WHEN event_id % 41 = 0 THEN NULL ELSE longitude END AS longitude,
       CASE WHEN event_id % 41 = 0 THEN NULL ELSE latitude END AS latitude
FROM {{evt}}
"""

_SQL["taxonomy"] = """
SELECT * FROM (VALUES
 ('A', 'click', 'strike', 'clash', 'armed', 'Violent Event'),
 ('A', 'view', 'march', 'assembly', 'civil', 'Other'),
 ('B', 'purchase', 'strike', 'clash', 'armed', 'Violent Event'),
 ('B', 'signup', 'rally', 'assembly', 'civil', 'Other'),
 ('C', 'error', 'raid', 'clash', 'armed', 'Violent Event')
) AS t(dataset, base_category, Level_1, Level_2, Level_3, Level_4_text)
"""

_SQL["unit_edges"] = """
SELECT * FROM (VALUES
 ('U1',0.11e0,0.11e0,0.91e0,0.11e0),('U1',0.91e0,0.11e0,0.91e0,0.91e0),('U1',0.91e0,0.91e0,0.51e0,0.41e0),
 ('U1',0.51e0,0.41e0,0.11e0,0.91e0),('U1',0.11e0,0.91e0,0.11e0,0.11e0),
 ('U2',1.01e0,0.11e0,1.91e0,0.11e0),('U2',1.91e0,0.11e0,1.91e0,0.91e0),('U2',1.91e0,0.91e0,1.01e0,0.91e0),
 ('U2',1.01e0,0.91e0,1.01e0,0.11e0),('U2',1.31e0,0.31e0,1.61e0,0.31e0),('U2',1.61e0,0.31e0,1.61e0,0.71e0),
 ('U2',1.61e0,0.71e0,1.31e0,0.71e0),('U2',1.31e0,0.71e0,1.31e0,0.31e0),
 ('U3',0.21e0,1.11e0,0.81e0,1.11e0),('U3',0.81e0,1.11e0,0.51e0,1.81e0),('U3',0.51e0,1.81e0,0.21e0,1.11e0),
 ('U3',1.21e0,1.11e0,1.81e0,1.21e0),('U3',1.81e0,1.21e0,1.51e0,1.91e0),('U3',1.51e0,1.91e0,1.21e0,1.11e0)
) AS t(unit_id, x1, y1, x2, y2)
"""

# Two units along one sloped border, which they walk in opposite directions, and points on and about it.
_SQL["sloped_edges"] = """
SELECT * FROM (VALUES
 ('V1',0.3e0,0.2e0,1.7e0,1.1e0),('V1',1.7e0,1.1e0,0.4e0,1.9e0),('V1',0.4e0,1.9e0,0.3e0,0.2e0),
 ('V2',1.7e0,1.1e0,0.3e0,0.2e0),('V2',0.3e0,0.2e0,1.9e0,0.1e0),('V2',1.9e0,0.1e0,1.7e0,1.1e0),
 ('V3',0.1e0,2.0e0,1.9e0,2.0e0),('V3',1.9e0,2.0e0,1.75e0,2.75e0),('V3',1.75e0,2.75e0,0.25e0,3.5e0),('V3',0.25e0,3.5e0,0.1e0,2.0e0),
 ('V4',1.75e0,2.75e0,1.9e0,2.0e0),('V4',1.9e0,2.0e0,3.0e0,3.5e0),('V4',3.0e0,3.5e0,0.25e0,3.5e0),('V4',0.25e0,3.5e0,1.75e0,2.75e0)
) AS t(unit_id, x1, y1, x2, y2)
"""
_SQL["border_points"] = """
SELECT event_id, 0.3e0 + (event_id % 1009) / 1009e0 * (1.7e0 - 0.3e0) AS longitude,
       0.2e0 + (event_id % 1009) / 1009e0 * (1.1e0 - 0.2e0) AS latitude FROM {events} WHERE event_id % 2 = 0
UNION ALL SELECT event_id, 0.25e0 + (event_id % 65) / 64e0 * 1.5e0, 3.5e0 - (event_id % 65) / 64e0 * 0.75e0 FROM {events} WHERE event_id % 2 = 1
"""

# One box per nation on the event lattice, with uncovered strips between boxes.
_SQL["nation_box"] = """
SELECT r_name AS NAME_0, n_name AS NAME_1, n_nationkey AS nk,
       (42 * (n_nationkey % 5) - 1) / 1e2 AS xa, (42 * (n_nationkey % 5) + 39) / 1e2 AS xb,
       (42 * floor(n_nationkey / 5) - 1) / 1e2 AS ya, (42 * floor(n_nationkey / 5) + 39) / 1e2 AS yb
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""
_SQL["nation_edges"] = """
SELECT NAME_0, NAME_1, xa AS x1, ya AS y1, xb AS x2, ya AS y2 FROM {nation_box}
UNION ALL SELECT NAME_0, NAME_1, xb, ya, xb, yb FROM {nation_box}
UNION ALL SELECT NAME_0, NAME_1, xb, yb, xa, yb FROM {nation_box}
UNION ALL SELECT NAME_0, NAME_1, xa, yb, xa, ya FROM {nation_box}
"""

_SQL["clusters"] = """
SELECT SurveyId, CLUSTER,
       CASE WHEN CLUSTER % 13 = 0 THEN NULL ELSE (yr * 37 + CLUSTER * 11) % 101 / 5e1 END AS LONGNUM,
       CASE WHEN CLUSTER % 13 = 0 THEN NULL ELSE (yr * 53 + CLUSTER * 7) % 103 / 5e1 END AS LATNUM
FROM (SELECT DISTINCT SurveyId, CLUSTER, hc19 AS yr FROM {resp}) c
"""

_SQL["catalog"] = """
SELECT DISTINCT SurveyId, NAME_0 AS country, 'DHS' AS surveyType, 'PR' AS fileType, hc19 AS surveyYear
FROM {resp}
"""

_SQL["surveys_agg"] = """
SELECT NAME_0 AS country, NAME_1 AS adm1, hc19 AS year, hc18 AS month,
       cast(length(NAME_1) % 2 AS int) AS MICS, cast(1 - length(NAME_1) % 2 AS int) AS SMART,
       avg(CASE WHEN hc72 < -200 THEN 1e0 WHEN hc72 < 9995 THEN 0e0 END) AS whz2,
       avg(CASE WHEN hc70 < -200 THEN 1e0 ELSE 0e0 END) AS haz2,
       avg(CASE WHEN hc71 < -200 THEN 1e0 WHEN hc71 < 9995 THEN 0e0 END) AS waz2,
       cast(count(*) AS double) AS respondents
FROM {resp} GROUP BY NAME_0, NAME_1, hc19, hc18
"""

# One row per raster cell with all bands, and the same unfolded for the oracle.
_SQL["cells"] = (
    """
SELECT vec_id AS cell_id, (vec_id % 25) * 8e-2 + 5e-3 AS x,
       floor(vec_id / 25) % 20 * 1e-1 + 5e-3 AS y,
       transform(embedding, (v, i) -> CASE WHEN (vec_id + i) % 17 = 0 THEN -9999e0 ELSE cast(v AS double) END) AS bands
FROM {embeddings}
""",
    """
SELECT vec_id AS cell_id, (vec_id % 25) * 8e-2 + 5e-3 AS x,
       floor(vec_id / 25) % 20 * 1e-1 + 5e-3 AS y, embedding FROM {embeddings}
""",
)
_SQL["cells_long"] = (
    """
SELECT cell_id, x, y, band, value FROM (SELECT cell_id, x, y, posexplode(bands) AS (band, value) FROM {cells}) u
""",
    """
SELECT cell_id, x, y, cast(band AS int) AS band,
       CASE WHEN (cell_id + band) % 17 = 0 THEN -9999e0 ELSE cast(v AS double) END AS value
FROM (SELECT cell_id, x, y, unnest(range(len(embedding))) AS band, unnest(embedding) AS v FROM {cells}) u
""",
)

_SQL["covariates_wide"] = """
SELECT n.n_name AS NAME_1, r.r_name AS NAME_0,
       sum(CASE WHEN year(o.o_orderdate) = 1995 THEN 1e0 ELSE 0e0 END) AS lights_1995_mean,
       sum(CASE WHEN year(o.o_orderdate) = 1996 THEN 1e0 ELSE 0e0 END) AS lights_1996_mean,
       sum(CASE WHEN year(o.o_orderdate) = 1997 THEN 1e0 ELSE 0e0 END) AS lights_1997_mean,
       sum(CASE WHEN year(o.o_orderdate) = 1998 THEN 1e0 ELSE 0e0 END) AS lights_1998_mean,
       sum(CASE WHEN year(o.o_orderdate) = 1998 THEN 1e0 ELSE 0e0 END) AS lights_1998_sum,
       cast(count(DISTINCT CASE WHEN year(o.o_orderdate) = 1995 THEN c.c_custkey END) AS double) AS pop_1995_mean,
       cast(count(DISTINCT CASE WHEN year(o.o_orderdate) = 1998 THEN c.c_custkey END) AS double) AS pop_1998_mean,
       cast(min(c.c_custkey) AS double) AS access_none_mean
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name, r.r_name
"""

# 64 grid boxes of a quarter degree, filled from the order book.
_SQL["grid"] = """
SELECT gid, cast(gid % 8 AS int) AS col, cast(floor(gid / 8) AS int) AS row,
       (gid % 8) * 25e-2 AS xmin, floor(gid / 8) * 25e-2 AS ymin,
       (gid % 8) * 25e-2 + 25e-2 AS xmax, floor(gid / 8) * 25e-2 + 25e-2 AS ymax, ttime
FROM (SELECT c_custkey % 64 AS gid, cast(count(*) AS double) AS ttime FROM {customer} GROUP BY c_custkey % 64) g
"""
_SQL["grid_yearly"] = """
SELECT gid, yr AS year,
       CASE WHEN (gid + yr) % 5 = 0 OR yr % 3 = 0 THEN NULL ELSE n * 3e0 END AS pop,
       n % 11 + 0e0 AS nlights
FROM (SELECT o_custkey % 64 AS gid, cast(year(o_orderdate) AS int) AS yr, count(*) AS n
      FROM {orders} GROUP BY o_custkey % 64, cast(year(o_orderdate) AS int)) g
"""

# Diamond cells about the middles of the grid boxes; neighbours overlap, some touch units at a point.
_SQL["diamonds"] = """
SELECT gid, cx + 15e-2 AS x1, cy AS y1, cx AS x2, cy + 2e-1 AS y2 FROM (SELECT gid, xmin + 125e-3 AS cx, ymin + 125e-3 AS cy FROM {grid}) a
UNION ALL SELECT gid, cx, cy + 2e-1, cx - 15e-2, cy FROM (SELECT gid, xmin + 125e-3 AS cx, ymin + 125e-3 AS cy FROM {grid}) b
UNION ALL SELECT gid, cx - 15e-2, cy, cx, cy - 2e-1 FROM (SELECT gid, xmin + 125e-3 AS cx, ymin + 125e-3 AS cy FROM {grid}) c
UNION ALL SELECT gid, cx, cy - 2e-1, cx + 15e-2, cy FROM (SELECT gid, xmin + 125e-3 AS cx, ymin + 125e-3 AS cy FROM {grid}) d
"""

# Units with type, and a substitute layer whose columns are named differently.
_SQL["layer_base"] = """
SELECT r_name AS NAME_0, concat(n_name, '/', s_name) AS NAME_1,
       CASE s_suppkey % 7 WHEN 0 THEN 'Water body' WHEN 1 THEN NULL ELSE 'State' END AS ENGTYPE_1
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""
_SQL["layer_alt"] = """
SELECT DISTINCT r_name AS CNTRYNAMEE, concat(n_name, '-', c_mktsegment) AS DHSREGEN
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""


def _text(name: str, engine: int) -> str:
    sql = _SQL[name]
    return sql if isinstance(sql, str) else sql[engine]


def _deps(sql: str) -> list[str]:
    return list(dict.fromkeys(f for _, f, _, _ in string.Formatter().parse(sql) if f))


class Inputs:
    """Stand-ins as DataFrames, built on demand from one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BASE and name not in _SQL):
            raise AttributeError(name)
        if name not in self._built:
            if name in BASE:
                path = f"{self.folder}/{name}.parquet"
                if path not in _SCHEMAS:
                    _SCHEMAS[path] = self.spark.read.parquet(path).schema
                self._built[name] = self.spark.read.schema(_SCHEMAS[path]).parquet(path)
            else:
                sql = _text(name, 0)
                args = {d: getattr(self, d) for d in _deps(sql)}
                args |= {d: shuffled(args[d]) for d in MOVED.get(name, ())}
                self._built[name] = self.spark.sql(sql, **args) if args else self.spark.sql(sql)
        return self._built[name]

    def table(self, sql: str) -> DataFrame:
        args = {d: getattr(self, d) for d in _deps(sql)}
        return self.spark.sql(sql, **args)


def oracle(sql: str) -> str:
    """Oracle text: the stand-ins that ``sql`` names as ``{name}``, then the query itself."""
    order: list[str] = []

    def visit(text: str) -> None:
        for d in _deps(text):
            if d not in BASE and d not in order:
                visit(_text(d, 1))
                order.append(d)

    visit(sql)
    plain = {d: d for d in (*BASE, *_SQL)}
    ctes = [f"{d} AS ({_text(d, 1).format(**plain).strip()})" for d in order]
    body = sql.format(**plain).strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


