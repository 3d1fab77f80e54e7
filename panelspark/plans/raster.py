"""Rasters: cells to unit-month means."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.dates import month_from_file_name
from panelspark.operators.spatial import to_sinusoidal, zonal_mean
from panelspark.plans.survey import UNIT
from panelspark.sources.files import read_csv


def read_raster_folder(
    spark: SparkSession, path: str, prefix: str, schema: str, years: Sequence[int] | None = None, header: bool = True
) -> DataFrame:
    """Cells of a folder of monthly CSV files with the month they are named after (``ymd``).

    A file, or the folder it lies in, is named ``<prefix><month word>.<year>``, as in
    ``tmax.March.1999``.  Files of other years, and names without a month, are left out before
    anything is read.
    """
    cells = read_csv(spark, path, schema, header)
    name = F.regexp_extract(F.col("_metadata.file_path"), f"[/=]({re.escape(prefix)}[^/]*)", 1)
    month = month_from_file_name(name)
    wanted = month.isNotNull() if years is None else F.year(month).isin(list(years))
    return cells.where(wanted).select(*cells.columns, month.alias("ymd"))


def raster_panel(
    cells: DataFrame,
    edges: DataFrame,
    unit: Sequence[str] = UNIT,
    value: str = "value",
    file_name: str | None = None,
    sinusoidal: bool = False,
    bands: DataFrame | None = None,
    tile: float | None = None,
) -> DataFrame:
    """Unit-month table ``(<unit>, ymd, <value>)`` of one raster product.

    The month comes from ``ymd``, from the file name the cells were read from, or from
    ``bands`` when a cell carries an array of all months.  For products on the
    sinusoidal grid the boundaries are moved to its metres; ``tile`` is then in metres and
    has to be named, a few cells wide.
    """
    if tile is None:
        if sinusoidal:
            raise ValueError("name the tile in metres for a product on the sinusoidal grid")
        tile = 0.25
    if file_name is not None:
        cells = cells.withColumn("ymd", month_from_file_name(file_name))
    if sinusoidal:
        edges = to_sinusoidal(edges, [("x1", "y1"), ("x2", "y2")])
    means = zonal_mean(cells, edges, unit, value=value, tile=tile, bands=bands)
    return means.select(*unit, "ymd", value)
