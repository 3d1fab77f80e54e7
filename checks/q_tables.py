"""Sources, projection, reshaping, filters and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks.registry import query
from checks.standins import FIRST_MONTH, LAST_MONTH
from panelspark.functions import (
    fix_mojibake,
    month_key,
    month_start,
    null_safe_paste,
    sentinel_null,
    split_pair,
    text_to_double,
    year_in_name,
)
from panelspark.operators import joins as J
from panelspark.operators import reshape as R
from panelspark.operators.panel import month_skeleton, on_skeleton
from panelspark.operators.spatial import admin_layer, replacement_layer
from panelspark.plans.survey import UNIT, clean_children, household_recodes
from panelspark.session import scratch_path, shared_root
from panelspark.sources import files
from panelspark.sources.boundaries import boundary_edges, read_layer
from panelspark.sources.surveys import attach_coordinates, choose_surveys, load_chosen

MONTHS = R.month_names(FIRST_MONTH, LAST_MONTH)
SKELETON = f"""SELECT u.NAME_0, u.NAME_1, m.ymd FROM (SELECT NAME_0, NAME_1 FROM {{unit_names}}) u
CROSS JOIN (SELECT cast(unnest(generate_series(DATE '{FIRST_MONTH}', DATE '{LAST_MONTH}', INTERVAL 1 MONTH)) AS date) AS ymd) m"""
PANEL = f"""SELECT s.NAME_0, s.NAME_1, s.ymd, p.rain, p.temp, p.veg FROM ({SKELETON}) s
LEFT JOIN {{panel}} p ON s.NAME_0 = p.NAME_0 AND s.NAME_1 = p.NAME_1 AND s.ymd = p.ymd"""
# Two regions of one country that a survey treats as one unit, and a plain renaming.
CROSSWALK = {"NATION_1": "Nation One", "NATION_6": "Nation One", "NATION_2": "Nation Two"}
CROSSWALK_SQL = "CASE NAME_1 WHEN 'NATION_1' THEN 'Nation One' WHEN 'NATION_6' THEN 'Nation One' WHEN 'NATION_2' THEN 'Nation Two' ELSE NAME_1 END"


def gap_free(i):
    return on_skeleton(i.panel, UNIT, FIRST_MONTH, LAST_MONTH, units=i.unit_names)


# ---- sources -------------------------------------------------------------------


@query(
    "scan_csv",
    """SELECT event_id, base_category AS EVENT_TYPE, fatalities AS FATALITIES,
    strftime(date, '%d/%m/%Y') AS EVENT_DATE, longitude AS LONGITUDE, latitude AS LATITUDE FROM {evt_months}""",
    doubles="LONGITUDE LATITUDE",
)
def scan_csv(i):
    path = scratch_path(i.spark, "feed_csv")
    i.evt_months.select(
        "event_id",
        F.col("base_category").alias("EVENT_TYPE"),
        F.col("fatalities").alias("FATALITIES"),
        F.date_format("date", "dd/MM/yyyy").alias("EVENT_DATE"),
        F.col("longitude").alias("LONGITUDE"),
        F.col("latitude").alias("LATITUDE"),
    ).write.csv(path, header=True, nullValue="NA")
    schema = "event_id long, EVENT_TYPE string, FATALITIES long, EVENT_DATE string, LONGITUDE double, LATITUDE double"
    return files.read_csv(i.spark, path, schema)


@query(
    "union_ragged",
    """SELECT NAME_0, NAME_1, lights_1995_mean,
    CASE WHEN NAME_0 IN ('AFRICA', 'AMERICA') THEN pop_1995_mean END AS pop_1995_mean,
    CASE WHEN NAME_0 NOT IN ('AFRICA', 'AMERICA') THEN access_none_mean END AS access_none_mean
    FROM {covariates_wide}""",
    doubles="lights_1995_mean pop_1995_mean access_none_mean",
)
def union_ragged(i):
    wide = i.covariates_wide
    parts = [
        wide.where("NAME_0 IN ('AFRICA', 'AMERICA')").select(*UNIT, "lights_1995_mean", "pop_1995_mean"),
        wide.where("NAME_0 IN ('ASIA', 'EUROPE')").select(*UNIT, "lights_1995_mean", "access_none_mean"),
        wide.where("NAME_0 = 'MIDDLE EAST'").select(
            F.col("NAME_0").alias("iso"), F.col("NAME_1").alias("NAME"), "access_none_mean", "lights_1995_mean"
        ),
    ]
    paths = []
    for n, part in enumerate(parts):
        paths.append(scratch_path(i.spark, f"covariates_{n}"))
        part.write.csv(paths[-1], header=True)
    stacked = files.read_ragged(
        i.spark,
        paths,
        types={"NAME_0": "string", "NAME_1": "string"},
        fallbacks={"iso": "NAME_0", "NAME": "NAME_1"},
    )
    return stacked.drop("source_file")


_BOX = "(VALUES (0,0,0,0,0,4,0),(0,0,1,4,0,4,4),(0,0,2,4,4,0,4),(0,0,3,0,4,0,0),(0,1,0,1,1,1,2),(0,1,1,1,2,2,2),(0,1,2,2,2,2,1),(0,1,3,2,1,1,1),(1,0,0,5,0,6,0),(1,0,1,6,0,6,1),(1,0,2,6,1,5,0)) AS e(part, ring, pos, xa, ya, xb, yb)"


@query(
    "boundary_edges",
    f"""SELECT s_suppkey AS unit_id, e.part, e.ring, e.pos,
    (5 * (s_suppkey % 50) + e.xa) / 1e1 AS x1, (5 * floor(s_suppkey / 50) + e.ya) / 1e1 AS y1,
    (5 * (s_suppkey % 50) + e.xb) / 1e1 AS x2, (5 * floor(s_suppkey / 50) + e.yb) / 1e1 AS y2
    FROM {{supplier}} CROSS JOIN {_BOX}
    WHERE (e.ring = 0 OR s_suppkey % 2 = 0) AND (e.part = 0 OR s_suppkey % 3 = 0)""",
    doubles="x1 y1 x2 y2",
)
def q_boundary_edges(i):
    kx, ky = F.col("s_suppkey") % 50 * 5, F.floor(F.col("s_suppkey") / 50) * 5

    def ring(*points):
        ends = [F.concat(F.lit("["), ((kx + x) / 10).cast("string"), F.lit(","), ((ky + y) / 10).cast("string"), F.lit("]")) for x, y in points]
        return F.concat(F.lit("["), F.concat_ws(",", *ends), F.lit("]"))

    outer = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    hole = ring((1, 1), (1, 2), (2, 2), (2, 1), (1, 1))
    islet = ring((5, 0), (6, 0), (6, 1), (5, 0))
    body = F.concat(F.lit("["), F.when(F.col("s_suppkey") % 2 == 0, F.concat_ws(",", outer, hole)).otherwise(outer), F.lit("]"))
    text = F.when(
        F.col("s_suppkey") % 3 == 0,
        F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), body, F.lit(",["), islet, F.lit("]]}")),
    ).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":'), body, F.lit("}")))
    layer = i.supplier.select(F.col("s_suppkey").alias("unit_id"), text.alias("geometry"))
    return boundary_edges(layer, ["unit_id"])


_OUTLINE = """SELECT NAME_0, cast(NULL AS string) AS NAME_1, 0 AS level, min(xa) AS xa, max(xb) AS xb, min(ya) AS ya, max(yb) AS yb FROM {nation_box} GROUP BY NAME_0
    UNION ALL SELECT NAME_0, NAME_1, 1, xa, xb, ya, yb FROM {nation_box}"""
_CORNERS = "(VALUES (0,0,0,1,0),(1,1,0,1,1),(2,1,1,0,1),(3,0,1,0,0)) AS e(pos, a, b, c, d)"


@query(
    "layer_levels",
    f"""SELECT level, NAME_0, NAME_1, pos, CASE WHEN a = 1 THEN xb ELSE xa END AS x1, CASE WHEN b = 1 THEN yb ELSE ya END AS y1,
    CASE WHEN c = 1 THEN xb ELSE xa END AS x2, CASE WHEN d = 1 THEN yb ELSE ya END AS y2
    FROM ({_OUTLINE.replace("AS string", "AS varchar")}) o CROSS JOIN {_CORNERS}
    WHERE level = 0 AND NAME_0 IN ('ASIA', 'EUROPE') OR level = 1 AND NAME_0 IN ('AFRICA', 'ASIA')""",
    doubles="x1 y1 x2 y2",
)
def layer_levels(i):
    """Writes one file per country and level and reads two countries of each level back."""
    path = scratch_path(i.spark, "layers")
    ends = [("xa", "ya"), ("xb", "ya"), ("xb", "yb"), ("xa", "yb"), ("xa", "ya")]
    ring = F.array(*[F.array(x, y) for x, y in ends])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("NAME_0", "NAME_1").alias("properties"), geometry.alias("geometry"))
    files = i.table(_OUTLINE).groupBy(F.concat_ws("_", "NAME_0", "level").alias("layer")).agg(
        F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value")
    )
    files.repartition("layer").write.partitionBy("layer").text(path)
    names = {"NAME_0": "NAME_0", "NAME_1": "NAME_1"}
    outer = read_layer(i.spark, path, names, ["ASIA", "EUROPE"], 0).withColumn("level", F.lit(0))
    inner = read_layer(i.spark, path, names, ["AFRICA", "ASIA"], 1).withColumn("level", F.lit(1))
    return boundary_edges(outer.unionByName(inner), ["level", *UNIT]).drop("part", "ring")


@query(
    "adm_layer",
    """SELECT NAME_0, NAME_1 FROM {layer_base} WHERE NAME_0 IN ('AFRICA', 'ASIA', 'EUROPE') AND ENGTYPE_1 <> 'Water body'
    UNION ALL SELECT CNTRYNAMEE, DHSREGEN FROM {layer_alt}
    UNION ALL SELECT 'Renamed Country', DHSREGEN FROM {layer_alt}""",
)
def q_adm_layer(i):
    names = {"CNTRYNAMEE": "NAME_0", "DHSREGEN": "NAME_1"}
    alt = replacement_layer(i.layer_alt, names)
    fixed = replacement_layer(i.layer_alt, names, country="Renamed Country")
    return admin_layer(i.layer_base, ["AFRICA", "ASIA", "EUROPE"], [alt, fixed])


@query(
    "catalog_select",
    """SELECT r.SurveyId, r.hc1, r.hc72, r.hv270 FROM {resp} r WHERE r.SurveyId IN
    (SELECT SurveyId FROM {catalog} WHERE country IN ('AFRICA', 'ASIA') AND surveyYear BETWEEN 1996 AND 1999)""",
)
def catalog_select(i):
    chosen = choose_surveys(i.catalog, ["AFRICA", "ASIA"], "DHS", "PR", 1996, 1999)
    return load_chosen(i.resp, chosen, ["hc1", "hc72", "hv270", "not_in_this_survey"])


@query(
    "label_decode",
    """SELECT CASE hc27 WHEN 1 THEN 'male' WHEN 2 THEN 'female' END AS hc27,
    CASE hc61 WHEN 0 THEN 'no education' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'higher' END AS hc61,
    count(*) AS n FROM {resp} GROUP BY 1, 2""",
)
def label_decode(i):
    labels = {
        "hc27": {1: "male", 2: "female"},
        "hc61": {0: "no education", 1: "primary", 2: "secondary", 3: "higher"},
    }
    return R.decode_labels(i.resp, labels).groupBy("hc27", "hc61").agg(F.count(F.lit(1)).alias("n"))


@query(
    "attach_geo",
    """SELECT r.SurveyId, r.CLUSTER, c.LONGNUM, c.LATNUM, count(*) AS n FROM {resp} r
    LEFT JOIN {clusters} c ON r.SurveyId = c.SurveyId AND r.CLUSTER = c.CLUSTER GROUP BY ALL""",
    doubles="LONGNUM LATNUM",
)
def attach_geo(i):
    placed = attach_coordinates(i.resp, i.clusters)
    return placed.groupBy("SurveyId", "CLUSTER", "LONGNUM", "LATNUM").agg(F.count(F.lit(1)).alias("n"))


@query("roundtrip", "SELECT * FROM {panel}", doubles="rain temp veg", dates="ymd")
def roundtrip(i):
    path = scratch_path(i.spark, "panel")
    files.save_table(i.panel, path, ["NAME_0"])
    return files.load_table(i.spark, path).select("NAME_0", "NAME_1", "ymd", "rain", "temp", "veg")


@query(
    "product_waves",
    """SELECT NAME_0, NAME_1, ymd, rain, lag(rain) OVER (PARTITION BY NAME_0, NAME_1 ORDER BY ymd) AS rain_before, veg FROM
    (SELECT NAME_0, NAME_1, ymd, CASE WHEN year(ymd) = 1996 THEN rain + 1000 ELSE rain END AS rain FROM {panel}) p JOIN
    (SELECT NAME_0, NAME_1, ymd, veg FROM {panel}) v USING (NAME_0, NAME_1, ymd)""",
    doubles="rain rain_before veg",
    dates="ymd",
)
def product_waves(i):
    """Two products in buckets, one year of one of them rewritten; the window and the join follow the layout."""
    tag = uuid.uuid4().hex
    wave = i.panel.withColumn("wave", F.year("ymd"))

    def save(df, name):
        return files.save_product(df, f"{name}_{tag}", f"{shared_root(i.spark)}/{name}-{tag}", UNIT, "wave", 8)

    save(wave.select(*UNIT, "ymd", "rain", "wave"), "rain")
    rain = save(wave.where("wave = 1996").select(*UNIT, "ymd", (F.col("rain") + 1000).alias("rain"), "wave"), "rain")
    veg = save(wave.select(*UNIT, "ymd", "veg", "wave"), "veg")
    before = F.lag("rain").over(W.partitionBy(*UNIT).orderBy("ymd")).alias("rain_before")
    return rain.join(veg.select(*UNIT, "ymd", "veg"), [*UNIT, "ymd"]).select(*UNIT, "ymd", "rain", before, "veg")


# ---- projection and reshape ----------------------------------------------------


@query("project", "SELECT NAME_0 AS country, NAME_1 AS unit, hc1 AS age, hv005 AS weight FROM {resp}")
def project(i):
    kept = i.resp.select(*UNIT, "hc1", "hv005", "CLUSTER").drop("CLUSTER")
    return kept.withColumnsRenamed({"NAME_0": "country", "NAME_1": "unit", "hc1": "age", "hv005": "weight"})


_COVS = "lights_1995_mean lights_1996_mean lights_1997_mean lights_1998_mean pop_1995_mean pop_1998_mean"


@query(
    "select_pattern",
    f"SELECT NAME_0, NAME_1, {', '.join(_COVS.split())} FROM {{covariates_wide}}",
    doubles=_COVS,
)
def select_pattern(i):
    return R.select_matching(i.covariates_wide, ["lights", "pop"], "mean", keep=UNIT)


@query(
    "year_from_name",
    " UNION ALL ".join(
        f"SELECT NAME_0, NAME_1, 'lights_{y}_mean' AS variable, lights_{y}_mean AS lights, {y} AS year FROM {{covariates_wide}}"
        for y in (1995, 1996, 1997, 1998)
    ),
    doubles="lights",
)
def year_from_name(i):
    wide = R.select_matching(i.covariates_wide, ["lights"], "mean", keep=UNIT)
    long = R.to_long(wide, UNIT, "variable", "lights")
    years = {c: year_in_name(c) for c in R.matching_columns(wide, ["lights"])}
    pairs = F.create_map(*[F.lit(p) for kv in years.items() for p in kv])
    return long.withColumn("year", F.element_at(pairs, F.col("variable")))


@query(
    "wide_months",
    f"""SELECT u.UniqueID + 1 AS UniqueID, u.NAME_0 AS country, replace(u.NAME_1, '_', ' ') AS region, p.ymd, p.rain
    FROM ({PANEL}) p JOIN {{unit_names}} u ON p.NAME_0 = u.NAME_0 AND p.NAME_1 = u.NAME_1""",
    doubles="rain",
    dates="ymd",
)
def wide_months(i):
    path = scratch_path(i.spark, "matrix_csv")
    months = [*MONTHS, "2001-12-01"]
    wide = R.to_wide(gap_free(i), UNIT, "ymd", "rain", months).join(
        i.unit_names.select(*UNIT, "UniqueID"), list(UNIT)
    )
    # One row per region, in region order, no names: the layout of the climate matrices.
    wide.orderBy("UniqueID").drop(*UNIT, "UniqueID").write.csv(
        path, header=False, nullValue="NaN"
    )
    named = R.name_months(
        files.read_wide_matrix(i.spark, path, len(MONTHS)), FIRST_MONTH, LAST_MONTH, ["row_id"]
    )
    country, region = split_pair("ID_LINK1")
    regions = i.unit_names.select(
        (F.col("UniqueID") + 1).alias("row_id"), country.alias("country"), region.alias("region")
    )
    labelled = named.join(regions, "row_id", "full")
    long = R.to_long(labelled, ["row_id", "country", "region"], "ymd", "rain")
    return long.withColumn("rain", sentinel_null("rain")).withColumnsRenamed({"row_id": "UniqueID"}).withColumn(
        "UniqueID", F.col("UniqueID").cast("int")
    )


@query("unpivot_months", f"SELECT NAME_0, NAME_1, cast(ymd AS varchar) AS ymd, rain FROM ({PANEL}) p", doubles="rain")
def unpivot_months(i):
    wide = R.to_wide(gap_free(i), UNIT, "ymd", "rain", MONTHS)
    return R.to_long(wide, UNIT, "ymd", "rain")


@query(
    "pivot_wide",
    "SELECT NAME_0, NAME_1, cast(year(ymd) AS int) AS year, "
    + ", ".join(f"max(CASE WHEN month(ymd) = {m} THEN rain END) AS rain_{m}" for m in range(1, 13))
    + " FROM {panel} GROUP BY NAME_0, NAME_1, year(ymd)",
    doubles=" ".join(f"rain_{m}" for m in range(1, 13)),
)
def pivot_wide(i):
    months = i.panel.select(
        *UNIT, F.year("ymd").alias("year"), F.concat(F.lit("rain_"), F.month("ymd")).alias("name"), "rain"
    )
    return R.to_wide(months, [*UNIT, "year"], "name", "rain", [f"rain_{m}" for m in range(1, 13)])


_OFFSETS = (*range(0, 15), 24, 36, 48, 60)


@query(
    "explode_lags",
    f"""SELECT NAME_0, NAME_1, ymd, cast(k AS int) AS n_lag,
    CASE WHEN k = 0 THEN 'rain' ELSE concat('lag_rain_', cast(k AS string)) END AS var_name, rain
    FROM {{panel}} CROSS JOIN (SELECT unnest([{', '.join(map(str, _OFFSETS))}]) AS k) o""",
    doubles="rain",
    dates="ymd",
)
def explode_lags(i):
    rows = R.explode_offsets(i.panel.select(*UNIT, "ymd", "rain"), _OFFSETS)
    name = F.when(F.col("n_lag") == 0, "rain").otherwise(null_safe_paste(F.lit("lag_rain_"), "n_lag"))
    return rows.withColumn("var_name", name)


@query(
    "split_name",
    """SELECT c_custkey, split_part(id, '_', 1) AS country,
    CASE WHEN c_custkey % 3 <> 0 THEN split_part(id, '_', 2) END AS region
    FROM (SELECT c_custkey, concat(r_name, CASE WHEN c_custkey % 3 <> 0 THEN concat('_', c_mktsegment) ELSE '' END,
          CASE WHEN c_custkey % 3 = 2 THEN '_extra' ELSE '' END) AS id
          FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey) t""",
)
def split_name(i):
    ids = i.table(
        """SELECT c_custkey, concat(r_name, CASE WHEN c_custkey % 3 <> 0 THEN concat('_', c_mktsegment) ELSE '' END,
        CASE WHEN c_custkey % 3 = 2 THEN '_extra' ELSE '' END) AS id
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""
    )
    country, region = split_pair("id")
    return ids.select("c_custkey", country.alias("country"), region.alias("region"))


@query(
    "scalar_suite",
    """SELECT NAME_0, NAME_1, cast(try_cast(hc63 AS double) AS double) AS hc63_number,
    concat(coalesce(hv270, 'NA'), '-', coalesce(hc63, 'NA')) AS pasted, substr(SurveyId, 1, 2) AS cc,
    cast(hc19 AS string) AS year_text, CASE WHEN hc70 < -200 THEN 1 ELSE 0 END AS low, count(*) AS n
    FROM {resp} GROUP BY ALL""",
    doubles="hc63_number",
)
def scalar_suite(i):
    return (
        i.resp.select(
            *UNIT,
            text_to_double("hc63").alias("hc63_number"),
            null_safe_paste("hv270", "hc63", sep="-").alias("pasted"),
            F.substring("SurveyId", 1, 2).alias("cc"),
            F.col("hc19").cast("string").alias("year_text"),
            (F.col("hc70") < -200).cast("int").alias("low"),
        )
        .groupBy(*UNIT, "hc63_number", "pasted", "cc", "year_text", "low")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "month_key",
    """SELECT NAME_0, NAME_1, ymd, ymd AS from_parts, cast(year(ymd) AS int) AS year, cast(month(ymd) AS int) AS month,
    cast(NULL AS varchar) AS bad, count(*) AS n FROM {resp} GROUP BY ALL""",
    dates="ymd from_parts",
)
def q_month_key(i):
    return (
        i.resp.select(
            *UNIT,
            month_key("ymd").alias("ymd"),
            month_start("hc19", "hc18").alias("from_parts"),
            F.year("ymd").alias("year"),
            F.month("ymd").alias("month"),
            month_start("hc19", F.col("hc18") + 12).alias("bad"),
        )
        .groupBy(*UNIT, "ymd", "from_parts", "year", "month", "bad")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "sentinel_null",
    "SELECT cell_id, band, CASE WHEN value <> -9999 THEN value END AS value FROM {cells_long}",
    doubles="value",
)
def q_sentinel_null(i):
    return i.cells_long.select("cell_id", "band", sentinel_null("value", [-9999.0]).alias("value"))


@query(
    "recode_labels",
    """SELECT hv270, hv204, hc63,
    CASE WHEN hv270 IN ('poorest', 'lowest') THEN 1 WHEN hv270 IN ('poorer', 'second') THEN 2 WHEN hv270 = 'middle' THEN 3
         WHEN hv270 IN ('richer', 'fourth') THEN 4 WHEN hv270 IN ('richest', 'highest') THEN 5 END AS wealth,
    try_cast(hc63 AS double) AS prebirthinterval,
    CASE hv204 WHEN 'on premises' THEN 0e0 WHEN 'more than 12 hours' THEN 720e0 WHEN '995+' THEN 995e0
         ELSE try_cast(hv204 AS double) END AS timetowater, count(*) AS n FROM {resp} GROUP BY ALL""",
    doubles="prebirthinterval timetowater",
)
def recode_labels(i):
    cols = ["hv270", "hv204", "hc63", "wealth", "prebirthinterval", "timetowater"]
    return household_recodes(i.resp).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


_CLEAN = """SELECT NAME_0, NAME_1, SurveyId, ymd, hc70 / 1e2 AS hc70, hc71 / 1e2 AS hc71, hc72 / 1e2 AS hc72,
    cast(hc72 / 1e2 < -2 AS int) AS whz2, cast(hc70 / 1e2 < -2 AS int) AS haz2, cast(hc71 / 1e2 < -2 AS int) AS waz2
    FROM {resp} WHERE hc1 <= 59 AND hc72 < 9995 AND hc71 < 9995 AND hc70 < 9995"""


@query("clean_zscores", _CLEAN, doubles="hc70 hc71 hc72", dates="ymd")
def clean_zscores(i):
    return clean_children(i.resp).select(
        *UNIT, "SurveyId", "ymd", "hc70", "hc71", "hc72", "whz2", "haz2", "waz2"
    )


@query("mojibake_fix", "SELECT doc_id, md5(text) AS digest, cast(length(text) AS int) AS n_chars FROM {documents}")
def mojibake_fix(i):
    # Every document is decoded with the wrong charset first, then repaired whole.
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    fixed = i.documents.select("doc_id", fix_mojibake(broken).alias("text"))
    return fixed.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))


# ---- filters -------------------------------------------------------------------


@query(
    "filter_sets",
    """SELECT NAME_0, NAME_1, hc1, hc72, hc27 FROM {resp} WHERE NAME_0 IN ('AFRICA', 'ASIA', 'EUROPE') AND hc19 > 1996
    AND hc72 IS NOT NULL AND hv270 <> 'middle' AND hc27 = 1""",
)
def filter_sets(i):
    return i.resp.where(
        F.col("NAME_0").isin("AFRICA", "ASIA", "EUROPE")
        & (F.col("hc19") > 1996)
        & F.col("hc72").isNotNull()
        & (F.col("hv270") != "middle")
        & (F.col("hc27") == 1)
    ).select(*UNIT, "hc1", "hc72", "hc27")


# ---- joins ---------------------------------------------------------------------


@query("month_skeleton", SKELETON, dates="ymd")
def q_month_skeleton(i):
    return month_skeleton(i.resp, UNIT, FIRST_MONTH, LAST_MONTH)


@query(
    "left_join_panel",
    """SELECT r.NAME_0, r.NAME_1, r.SurveyId, r.ymd, r.n, p.rain, p.temp FROM
    (SELECT NAME_0, NAME_1, SurveyId, ymd, count(*) AS n FROM {resp} GROUP BY ALL) r
    LEFT JOIN {panel} p ON r.NAME_0 = p.NAME_0 AND r.NAME_1 = p.NAME_1 AND r.ymd = p.ymd""",
    doubles="rain temp",
    dates="ymd",
)
def left_join_panel(i):
    months = i.resp.groupBy(*UNIT, "SurveyId", "ymd").agg(F.count(F.lit(1)).alias("n"))
    # The climate side names its keys differently.
    climate = i.panel.select(F.col("NAME_0").alias("country"), F.col("NAME_1").alias("adm1"), "ymd", "rain", "temp")
    renamed = climate.withColumnsRenamed({"country": "NAME_0", "adm1": "NAME_1"})
    return months.join(renamed, [*UNIT, "ymd"], "left").select(*UNIT, "SurveyId", "ymd", "n", "rain", "temp")


@query(
    "full_join_panel",
    """SELECT NAME_0, NAME_1, cast(ymd AS date) AS ymd, rain, n_interviews, n_orders FROM
    (SELECT NAME_0, NAME_1, ymd, rain FROM {panel}) p
    FULL JOIN (SELECT NAME_0, NAME_1, ymd, count(*) AS n_interviews FROM {resp} WHERE hc1 > 59 GROUP BY ALL) r USING (NAME_0, NAME_1, ymd)
    FULL JOIN (SELECT NAME_0, NAME_1, ymd + INTERVAL 5 MONTH AS ymd, count(*) AS n_orders FROM {resp} GROUP BY ALL) o USING (NAME_0, NAME_1, ymd)""",
    doubles="rain",
    dates="ymd",
)
def full_join_panel(i):
    keys = [*UNIT, "ymd"]
    older = i.resp.where("hc1 > 59").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_interviews"))
    later = i.resp.groupBy(*UNIT, F.add_months("ymd", 5).alias("ymd")).agg(F.count(F.lit(1)).alias("n_orders"))
    return J.full_join([i.panel.select(*keys, "rain"), older, later], keys)


@query(
    "join_null_safe",
    """SELECT a.NAME_0, a.hv270, a.n, b.m FROM (SELECT NAME_0, hv270, count(*) AS n FROM {resp} GROUP BY ALL) a
    FULL JOIN (SELECT NAME_0, hv270, avg(hc70) AS m FROM {resp} GROUP BY ALL) b
    ON a.NAME_0 IS NOT DISTINCT FROM b.NAME_0 AND a.hv270 IS NOT DISTINCT FROM b.hv270""",
    doubles="m",
)
def join_null_safe(i):
    keys = ["NAME_0", "hv270"]
    a = i.resp.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    b = i.resp.groupBy(*keys).agg(F.avg("hc70").alias("m"))
    return J.null_safe_join(a, b, keys, "full")


@query(
    "name_mismatch",
    f"""WITH a AS (SELECT DISTINCT NAME_0, NAME_1 FROM {{resp}}),
    b AS (SELECT DISTINCT NAME_0, {CROSSWALK_SQL} AS NAME_1 FROM {{panel}})
    SELECT *, 'survey' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x
    UNION ALL SELECT *, 'climate' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a) y""",
)
def name_mismatch(i):
    return J.name_mismatch(i.resp, J.rename_units(i.panel, "NAME_1", CROSSWALK), UNIT, ("survey", "climate"))


_ALLCOVS = _COVS + " lights_1998_sum access_none_mean"


@query(
    "name_crosswalk",
    f"SELECT NAME_0, {CROSSWALK_SQL} AS NAME_1, "
    + ", ".join(f"avg({c}) AS {c}" for c in _ALLCOVS.split())
    + " FROM {covariates_wide} GROUP BY 1, 2",
    doubles=_ALLCOVS,
)
def name_crosswalk(i):
    from panelspark.operators.aggregate import mean_all

    table = i.spark.createDataFrame(list(CROSSWALK.items()), "old_name string, new_name string")
    return mean_all(J.rename_units(i.covariates_wide, "NAME_1", table), UNIT)


@query("distinct_names", "SELECT DISTINCT NAME_0, NAME_1, SurveyId FROM {resp}")
def distinct_names(i):
    return i.resp.select(*UNIT, "SurveyId").distinct()
