"""Points, grid cells and rasters against administrative units.

Units are edge tables: one row per polygon segment ``(<unit columns>, x1, y1, x2,
y2)``.  Holes and multi-part units need no special case, because a point is inside
when a ray from it crosses an odd number of the unit's segments.

``unit_index`` cuts the plane into square tiles and keeps, per unit and tile,
either "entirely inside" or the few segments that can decide a point of the tile.
With that index a point needs one hash lookup and no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.nulls import sentinel_null
from panelspark.operators.joins import split_join
from panelspark.session import written

# Mean sphere radius in metres used by the sinusoidal raster grid (fixed value).
SINUSOIDAL_RADIUS = 6371007.181
# Halves the 53 bits of a double; bound of a rounded determinant's error (fixed values).
SPLITTER = 134217729.0
SIDE_ERROR = 3.3306690738754716e-16
# Columns of an edge table beside its unit.
SEGMENT = ("x1", "y1", "x2", "y2")
# An index with more segments than this is joined by shuffle instead of broadcast.
BROADCAST_SEGMENTS = 2_000_000


def _tile(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("int")


def _two_difference(a: Column, b: Column) -> tuple[Column, Column]:
    """``a - b`` rounded, and what rounding left out."""
    d = a - b
    virtual = a - d
    return d, (a - (d + virtual)) + (virtual - b)


def _two_product(a: Column, b: Column) -> Column:
    """``[error, a * b rounded]``; the two add up to the product exactly."""

    def high(v: Column) -> Column:
        return v * F.lit(SPLITTER) - (v * F.lit(SPLITTER) - v)

    def low(v: Column) -> Column:
        return v - high(v)

    p = a * b
    return F.array(low(a) * low(b) - (((p - high(a) * high(b)) - low(a) * high(b)) - high(a) * low(b)), p)


def _sign_of_sum(terms: Column) -> Column:
    """Exact sign of a sum of doubles, by an expansion whose parts do not overlap."""
    nothing = F.array().cast("array<double>")

    def carry(done: Column, part: Column) -> Column:
        total = done["q"] + part
        virtual = total - done["q"]
        rest = (done["q"] - (total - virtual)) + (part - virtual)
        return F.struct(total.alias("q"), F.concat(done["h"], F.array(rest)).alias("h"))

    def add(parts: Column, term: Column) -> Column:
        start = F.struct(term.alias("q"), nothing.alias("h"))
        return F.aggregate(
            parts, start, carry, lambda done: F.filter(F.concat(done["h"], F.array(done["q"])), lambda v: v != 0)
        )

    # Parts grow in size: the last one has the sign of all.
    return F.signum(F.coalesce(F.try_element_at(F.aggregate(terms, nothing, add), F.lit(-1)), F.lit(0.0)))


def orientation(e: Column, px: Column, py: Column) -> Column:
    """Side of the line through a segment on which a point lies: 1 left, -1 right, 0 on it, exactly.

    The rounded determinant decides unless it is within its own error bound; then it is summed
    without error.  Both walks along a border therefore give opposite signs, for every point.
    """
    rise_left = (e["x2"] - e["x1"]) * (py - e["y1"])
    run_right = (e["y2"] - e["y1"]) * (px - e["x1"])
    sure = F.abs(rise_left - run_right) > F.lit(SIDE_ERROR) * (F.abs(rise_left) + F.abs(run_right))
    factors = []
    for a, b, c, d, sign in (
        (e["x2"], e["x1"], py, e["y1"], 1.0),
        (e["y2"], e["y1"], px, e["x1"], -1.0),
    ):
        factors += [
            F.struct((F.lit(sign) * u).alias("a"), v.alias("b"))
            for u in _two_difference(a, b)
            for v in _two_difference(c, d)
        ]
    terms = F.flatten(F.transform(F.array(*factors), lambda f: _two_product(f["a"], f["b"])))
    return F.when(sure, F.signum(rise_left - run_right)).otherwise(_sign_of_sum(terms))


def _meets(e: Column, px: Column, py: Column) -> Column:
    """2 when the point lies on the segment, 1 when the segment crosses its ray towards larger x, else 0."""
    lower, upper = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    left, right = F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])
    spans = (e["y1"] > py) != (e["y2"] > py)
    ahead = orientation(e, px, py) * F.signum(e["y2"] - e["y1"])
    # Only a segment around the point needs its side: the box of the others decides.
    return (
        F.when(~py.between(lower, upper) | (px > right), 0)
        .when(px < left, spans.cast("int"))
        .otherwise(
            F.aggregate(
                F.array(F.when(upper > lower, ahead).otherwise(F.lit(0.0))),
                F.lit(0),
                lambda _, side: F.when(side == 0, 2).when((side > 0) & spans, 1).otherwise(0),
            )
        )
    )


def _inside(segments: Column, heights: Column, px: Column, py: Column) -> Column:
    """Inside or on the border: a point on a shared border belongs to both units."""
    met = F.transform(segments, lambda e: F.coalesce(_meets(e, px, py), F.lit(0)))
    right_of_tile = F.size(F.filter(heights, lambda h: h > py))
    tally = F.aggregate(
        met,
        F.struct(right_of_tile.alias("n"), F.lit(False).alias("on")),
        lambda t, m: F.struct((t["n"] + F.when(m == 1, 1).otherwise(0)).alias("n"), (t["on"] | (m == 2)).alias("on")),
        lambda t: t["on"] | (t["n"] % 2 == 1),
    )
    return tally


def unit_index(
    edges: DataFrame, unit: Sequence[str] = ("unit_id",), tile: float = 0.25
) -> DataFrame:
    """Tiles of each unit: ``(<unit>, tx, ty, segments, heights)``; both NULL for inner tiles.

    A border tile keeps the segments that touch it.  Segments right of it are crossed
    by a ray exactly when the point's height lies between their ends, so of those only
    the end heights matter, and heights that occur twice cancel: a chain of any length
    leaves its two ends.  The index therefore grows with the boundaries' detail, not
    with their detail times the number of tiles, and never with the points.
    """
    unit = list(unit)
    slack = tile * 1e-9
    bottom = F.col("ty") * F.lit(tile)
    top = bottom + F.lit(tile)
    segments = edges.select(*unit, "x1", "y1", "x2", "y2").withColumns(
        {
            "ty": F.explode(F.sequence(_tile(F.least("y1", "y2"), tile), _tile(F.greatest("y1", "y2"), tile))),
            "t0": _tile(F.least("x1", "x2") - F.lit(slack), tile),
            "t1": _tile(F.greatest("x1", "x2") + F.lit(slack), tile),
        }
    )
    touching = (
        segments.withColumn("tx", F.explode(F.sequence("t0", "t1")))
        .groupBy(*unit, "ty", "tx")
        .agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("segments"))
    )

    def height(v: Column) -> Column:
        """Above the row is above every point of it; below the row never counts."""
        return F.when(v > top + slack, F.lit(float("inf"))).when(v >= bottom - slack, v)

    # Ends cancel within a column of the row first, so only where a chain enters or leaves it one is left.
    ends = (
        segments.select(*unit, "ty", "t0", F.explode(F.array(height(F.col("y1")), height(F.col("y2")))).alias("h"))
        .groupBy(*unit, "ty", "t0", "h")
        .agg((F.count(F.lit(1)) % 2).alias("odd"))
    )
    left_over = F.when((F.col("odd") == 1) & F.col("h").isNotNull(), F.struct("t0", "h"))
    rows = ends.groupBy(*unit, "ty").agg(F.collect_list(left_over).alias("ends"))
    spans = edges.groupBy(*unit).agg(
        _tile(F.min(F.least("x1", "x2")), tile).alias("tx0"),
        _tile(F.max(F.greatest("x1", "x2")), tile).alias("tx1"),
    )
    beyond = F.transform(F.filter("ends", lambda e: e["t0"] > F.col("tx")), lambda e: e["h"])
    nothing = F.array().cast("array<double>")
    odd_ends = F.aggregate(
        F.array_sort(beyond),
        nothing,
        lambda kept, v: F.when(
            F.try_element_at(kept, F.lit(-1)) == v, F.slice(kept, F.lit(1), F.size(kept) - 1)
        ).otherwise(F.concat(kept, F.array(v))),
    )
    tiles = (
        rows.join(spans, unit)
        .withColumn("tx", F.explode(F.sequence("tx0", "tx1")))
        .withColumn("heights", odd_ends)
        .join(touching, [*unit, "ty", "tx"], "left")
        .withColumn("segments", F.coalesce("segments", F.array().cast(touching.schema["segments"].dataType)))
    )
    border = F.size("segments") > 0
    middle = bottom + F.lit(tile / 2)
    inner = F.size(F.filter("heights", lambda h: h > middle)) % 2 == 1
    return tiles.where(border | inner).select(
        *unit,
        "tx",
        "ty",
        F.when(border, F.col("segments")).alias("segments"),
        F.when(border, F.col("heights")).alias("heights"),
    )


def assign_units(
    points: DataFrame,
    edges: DataFrame,
    unit: Sequence[str] = ("unit_id",),
    x: str = "longitude",
    y: str = "latitude",
    how: str = "left",
    tile: float = 0.25,
    max_segments: int = BROADCAST_SEGMENTS,
) -> DataFrame:
    """Units that contain or touch each point; ``how="left"`` keeps points outside all.

    The index is measured first.  Within the bound it is broadcast and the points
    are not shuffled at all.  Beyond it, distinct locations are matched by a
    shuffle join on the tile (hot tiles split) and joined back to the points.
    """
    index, seen = written(
        unit_index(edges, unit, tile).withColumnsRenamed({"tx": "__tx", "ty": "__ty"}),
        "unit_index",
        segments=F.sum(
            1 + F.when(F.col("segments").isNull(), 0).otherwise(F.size("segments") + F.size("heights"))
        ),
    )
    if (seen["segments"] or 0) <= max_segments:
        px, py = points[x], points[y]
        hit = F.col("segments").isNull() | _inside(F.col("segments"), F.col("heights"), px, py)
        on_tile = (_tile(px, tile) == F.col("__tx")) & (_tile(py, tile) == F.col("__ty"))
        joined = points.join(F.broadcast(index), on_tile & hit, how)
        return joined.select(*points.columns, *unit)

    places = (
        points.select(x, y)
        .where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .distinct()
        .withColumns({"__tx": _tile(F.col(x), tile), "__ty": _tile(F.col(y), tile)})
    )
    found = (
        split_join(places, index, ["__tx", "__ty"])
        .where(
            F.col("segments").isNull()
            | _inside(F.col("segments"), F.col("heights"), F.col(x), F.col(y))
        )
        .select(x, y, *unit)
    )
    return split_join(points, found, [x, y], how).select(*points.columns, *unit)


def box_units(
    boxes: DataFrame,
    edges: DataFrame,
    box_id: str = "gid",
    unit: Sequence[str] = ("unit_id",),
    tile: float = 0.25,
) -> DataFrame:
    """Pairs ``(box, unit)`` that intersect; boxes are ``xmin, ymin, xmax, ymax``.

    They intersect when a segment of the unit meets the box, or when the box lies
    wholly inside, which one corner decides.  Segments and boxes are compared when
    they share a tile, so a tile should be about the size of a box.
    """
    unit = list(unit)

    def tiles(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame:
        return df.withColumn("__tx", F.explode(F.sequence(_tile(x0, tile), _tile(x1, tile)))).withColumn(
            "__ty", F.explode(F.sequence(_tile(y0, tile), _tile(y1, tile)))
        )

    sides = ["xmin", "ymin", "xmax", "ymax"]
    segs = tiles(
        edges.select(*unit, "x1", "y1", "x2", "y2"),
        F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2"),
    )
    cells = tiles(
        boxes.select(box_id, *sides).distinct(), *(F.col(c) for c in ("xmin", "xmax", "ymin", "ymax"))
    )

    def side(cx: str, cy: str) -> Column:
        """Which side of the segment's line a corner is on."""
        return (F.col("x2") - F.col("x1")) * (F.col(cy) - F.col("y1")) - (
            F.col("y2") - F.col("y1")
        ) * (F.col(cx) - F.col("x1"))

    corners = [side(cx, cy) for cx in ("xmin", "xmax") for cy in ("ymin", "ymax")]
    apart = (F.least(*corners) > 0) | (F.greatest(*corners) < 0)
    overlap = (
        (F.greatest("x1", "x2") >= F.col("xmin"))
        & (F.least("x1", "x2") <= F.col("xmax"))
        & (F.greatest("y1", "y2") >= F.col("ymin"))
        & (F.least("y1", "y2") <= F.col("ymax"))
    )
    met = split_join(segs, cells, ["__tx", "__ty"]).where(overlap & ~apart).select(box_id, *unit)
    within = assign_units(
        boxes.select(box_id, "xmin", "ymin").distinct(), edges, unit, "xmin", "ymin", "inner", tile
    ).select(box_id, *unit)
    return met.unionByName(within).distinct()


def polygon_pairs(
    left: DataFrame,
    right: DataFrame,
    left_unit: Sequence[str],
    right_unit: Sequence[str],
    tile: float = 0.25,
) -> DataFrame:
    """Pairs of units of two edge tables whose areas or borders meet, for any polygons.

    Two units meet when a segment of one meets a segment of the other, or when a ring of one lies
    inside the other, which any of its points decides.  Segments are compared where they
    share a tile, by exact sides, so units that only touch are found from both walks of a border.
    Unit columns of the two tables have different names.
    """
    left_unit, right_unit = list(left_unit), list(right_unit)

    def tiled(edges: DataFrame, unit: list[str], side: str) -> DataFrame:
        x0, x1 = F.least("x1", "x2"), F.greatest("x1", "x2")
        y0, y1 = F.least("y1", "y2"), F.greatest("y1", "y2")
        return (
            edges.withColumn("__tx", F.explode(F.sequence(_tile(x0, tile), _tile(x1, tile))))
            .withColumn("__ty", F.explode(F.sequence(_tile(y0, tile), _tile(y1, tile))))
            .select(*unit, "__tx", "__ty", F.struct("x1", "y1", "x2", "y2").alias(side))
        )

    a, b = F.col("__a"), F.col("__b")

    def overlap(c: str) -> Column:
        return (F.greatest(a[f"{c}1"], a[f"{c}2"]) >= F.least(b[f"{c}1"], b[f"{c}2"])) & (
            F.greatest(b[f"{c}1"], b[f"{c}2"]) >= F.least(a[f"{c}1"], a[f"{c}2"])
        )

    def parted(line: Column, other: Column) -> Column:
        """Both ends of ``other`` lie on the same side of a segment's line."""
        return orientation(line, other["x1"], other["y1"]) * orientation(line, other["x2"], other["y2"]) > 0

    near = split_join(tiled(left, left_unit, "__a"), tiled(right, right_unit, "__b"), ["__tx", "__ty"])
    met = near.where(overlap("x") & overlap("y")).where(~parted(a, b) & ~parted(b, a)).select(*left_unit, *right_unit)

    def inside(rings: DataFrame, unit: list[str], edges: DataFrame, other: list[str]) -> DataFrame:
        """One point per ring where rings are told apart, else every point."""
        ring = [c for c in ("part", "ring") if c in rings.columns]
        points = rings.select(*unit, F.col("x1").alias("__x"), F.col("y1").alias("__y"))
        if len(ring) == 2:
            points = rings.groupBy(*unit, *ring).agg(F.min(F.struct("x1", "y1")).alias("__p"))
            points = points.select(*unit, F.col("__p.x1").alias("__x"), F.col("__p.y1").alias("__y"))
        return assign_units(points.distinct(), edges, other, "__x", "__y", "inner", tile).select(*left_unit, *right_unit)

    return (
        met.unionByName(inside(left, left_unit, right, right_unit))
        .unionByName(inside(right, right_unit, left, left_unit))
        .distinct()
    )


def zonal_mean(
    cells: DataFrame,
    edges: DataFrame,
    unit: Sequence[str] = ("unit_id",),
    time: str = "ymd",
    value: str = "value",
    x: str = "x",
    y: str = "y",
    no_data: Sequence[float] = (-9999.0,),
    tile: float = 0.25,
    bands: DataFrame | None = None,
) -> DataFrame:
    """Mean of the raster cells whose centre lies in each unit, per time step.

    Two layouts: one row per cell and step, or one row per cell with the array of
    all bands in ``value`` and ``bands`` naming the step of each position.  In the
    second the cell is located once for all bands.  Either way the cells are not
    shuffled, only the partial sums per unit and step are.
    """
    located = assign_units(cells, edges, unit, x, y, "inner", tile)
    if bands is None:
        return located.groupBy(*unit, time).agg(
            F.avg(sentinel_null(value, no_data)).alias(value)
        )
    long = located.select(*unit, F.posexplode(value).alias("band", "__v"))
    means = long.groupBy(*unit, "band").agg(F.avg(sentinel_null("__v", no_data)).alias(value))
    return means.join(bands, "band")


def climatology(
    panel: DataFrame, unit: Sequence[str], time: str = "ymd", value: str = "value"
) -> DataFrame:
    """Mean per unit and calendar month; NULL when one of the years is."""
    from panelspark.functions.aggregates import na_avg

    return panel.groupBy(*unit, F.month(time).alias("month")).agg(na_avg(value).alias(value))


def to_sinusoidal(
    df: DataFrame, pairs: Sequence[tuple[str, str]], radius: float = SINUSOIDAL_RADIUS
) -> DataFrame:
    """Longitude/latitude columns in degrees to sinusoidal metres, in place."""
    rad = math.pi / 180

    def project(lon: str, lat: str) -> dict[str, Column]:
        phi = F.col(lat) * F.lit(rad)
        return {
            lon: F.lit(radius) * (F.col(lon) * F.lit(rad)) * F.cos(phi),
            lat: F.lit(radius) * phi,
        }

    return df.withColumns(reduce(lambda a, b: a | b, [project(*p) for p in pairs]))


def admin_layer(
    base: DataFrame,
    countries: Sequence[str],
    replacements: Sequence[DataFrame] = (),
    unit_type: str = "ENGTYPE_1",
    excluded: str = "Water body",
    keep: Sequence[str] = ("NAME_0", "NAME_1"),
) -> DataFrame:
    """One layer from a base layer and replacement layers.

    Base units of the wanted countries stay unless excluded by type; an unknown
    type is dropped too.  Replacement layers come renamed to the same columns.
    """
    layer = base.where(F.col("NAME_0").isin(list(countries)) & (F.col(unit_type) != excluded))
    parts = [layer.select(*keep), *[r.select(*keep) for r in replacements]]
    return reduce(DataFrame.unionByName, parts)


def replacement_layer(
    df: DataFrame, renames: dict[str, str], country: str | None = None
) -> DataFrame:
    """A substitute layer under the base layer's column names, country optionally fixed."""
    out = df.withColumnsRenamed(renames)
    return out if country is None else out.withColumn("NAME_0", F.lit(country))
