"""Yearly covariates from wide files and from a grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.scalars import year_in_name
from panelspark.operators import panel as P
from panelspark.operators.aggregate import mean_all
from panelspark.operators.joins import lookup_join
from panelspark.operators.reshape import matching_columns
from panelspark.operators.spatial import box_units
from panelspark.plans.survey import UNIT


def yearly_series(
    wide: DataFrame,
    ids: Sequence[str],
    series: Mapping[str, str],
    first: int,
    last: int,
    static: Mapping[str, str] | None = None,
    suffix: str = "",
) -> DataFrame:
    """Long unit-year table from columns whose names carry the year.

    ``series`` maps an output column to the prefix of its yearly columns, ``static``
    an output column to a column without year.  Each unit's row unfolds once into
    one struct per year holding all series, so no series is joined to another;
    skeleton years without data are there with NULLs.
    """
    by_year: dict[int, dict[str, str]] = {y: {} for y in range(first, last + 1)}
    for name, prefix in series.items():
        for c in matching_columns(wide, [prefix], suffix):
            year = year_in_name(c)
            if year is None:
                continue
            other = by_year.setdefault(year, {}).setdefault(name, c)
            if other != c:
                raise ValueError(f"{other} and {c} are both series {name} in {year}; name a suffix")
    null = F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(year).alias("year"),
            *[
                (F.col(f"`{have[n]}`").cast("double") if n in have else null).alias(n)
                for n in series
            ],
        )
        for year, have in sorted(by_year.items())
    ]
    fixed = [F.col(f"`{c}`").cast("double").alias(n) for n, c in (static or {}).items()]
    return wide.select(*ids, *fixed, F.explode(F.array(*rows)).alias("__y")).select(
        *ids, "__y.*", *(static or {})
    )


def yearly_covariates(
    wide: DataFrame,
    series: Mapping[str, str],
    first: int,
    last: int,
    carried: Sequence[str],
    static: Mapping[str, str] | None = None,
    suffix: str = "",
    unit: Sequence[str] = UNIT,
) -> DataFrame:
    """Unit-year covariates: carried forward where sparse, with lags 1 and 2.

    Files that list a unit twice are averaged first, so a unit has one row per year.
    """
    long = yearly_series(wide, unit, series, first, last, static, suffix)
    steps = P.one_row_per_step(long, unit, "year", [*series, *(static or {})])
    filled = P.carry_forward(steps, unit, "year", carried)
    return P.yearly_lags(filled, unit, {n: n for n in series})


def grid_covariates(
    boxes: DataFrame,
    static: DataFrame,
    yearly: DataFrame,
    edges: DataFrame,
    carried_prefixes: Sequence[str],
    last: int,
    extra_years: Sequence[int],
    unit: Sequence[str] = UNIT,
    tile: float = 0.25,
) -> DataFrame:
    """Grid covariates averaged over the cells each unit meets, per year.

    Cells count equally and a border cell counts in each unit it touches.  Sparse
    series are carried forward, the last year is repeated for later years, and the
    whole panel is then moved one year ahead.
    """
    pairs = box_units(boxes, edges, "gid", unit, tile)
    cells = lookup_join(lookup_join(yearly, pairs, ["gid"], "inner"), static, ["gid"], "left")
    means = mean_all(cells, [*unit, "year"], drop=["gid"])
    carried = matching_columns(means, list(carried_prefixes))
    filled = P.carry_forward(means, unit, "year", carried)
    return P.shift_years(P.extend_last_year(filled, last, extra_years))
