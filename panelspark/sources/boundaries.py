"""Boundary layers: folders of GeoJSON files, GeoJSON text to edge tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POLYGON = "array<array<array<double>>>"
_MULTI = f"array<{_POLYGON}>"


def _shape(body: Column) -> Column:
    """A single GeoJSON geometry as a multipolygon; anything that is no area raises."""
    kind = F.get_json_object(body, "$.type")
    coords = F.get_json_object(body, "$.coordinates")
    refusal = F.raise_error(F.concat(F.lit("no polygon geometry: "), F.substring(body, 1, 80)))
    return (
        F.when(body.isNull(), F.lit(None).cast(_MULTI))
        .when(kind == "Polygon", F.array(F.from_json(coords, _POLYGON)))
        .when(kind == "MultiPolygon", F.from_json(coords, _MULTI))
        .otherwise(refusal.cast(_MULTI))
    )


def _geometry(body: Column) -> Column:
    """The geometry of a feature; other text as it is."""
    feature = F.get_json_object(body, "$.type") == "Feature"
    return F.when(feature, F.get_json_object(body, "$.geometry")).otherwise(body)


def _collected(body: Column) -> Column:
    """Like ``_shape``, geometry collections taken apart as well."""
    members = F.from_json(F.get_json_object(body, "$.geometries"), "array<string>")
    together = F.flatten(F.filter(F.transform(members, _shape), lambda m: m.isNotNull()))
    return F.when(F.get_json_object(body, "$.type") == "GeometryCollection", together).otherwise(_shape(body))


def parse_geometry(text: Column | str) -> Column:
    """GeoJSON text as one multipolygon (array of polygons of rings).

    Takes polygons, multipolygons, geometry collections, features and feature collections of them.  A null
    text or a feature without geometry is NULL and adds nothing to a collection; points, lines and
    other text raise.
    """
    body = F.col(text) if isinstance(text, str) else text
    features = F.from_json(F.get_json_object(body, "$.features"), "array<string>")
    parts = F.filter(F.transform(features, lambda f: _collected(_geometry(f))), lambda m: m.isNotNull())
    return F.when(F.get_json_object(body, "$.type") == "FeatureCollection", F.flatten(parts)).otherwise(_collected(_geometry(body)))


def read_layer(
    spark: SparkSession,
    path: str,
    properties: Mapping[str, str],
    countries: Sequence[str] | None = None,
    level: int | None = None,
    pattern: str = "{country}_{level}",
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per feature of a folder of GeoJSON files: the wanted properties and ``geometry`` text.

    ``properties`` maps column names to property names; a property that a file lacks is NULL.
    ``types`` casts columns, unreadable values to NULL.  Files hold one FeatureCollection or Feature each.

    Files lie by country and administrative level, and their path says so: ``pattern`` stands
    between separators (``/ _ . - =``) of the path.  ``countries`` and ``level`` choose files
    before anything is read.
    """
    types = dict(types or {})
    feature = "struct<type:string,properties:map<string,string>,geometry:string>"
    schema = f"type string, features array<{feature}>, properties map<string,string>, geometry string"
    files = spark.read.schema(schema).json(path, multiLine=True)
    if countries is not None or level is not None:
        names = "(?:" + "|".join(map(re.escape, countries)) + ")" if countries is not None else "[A-Za-z]+"
        number = "[0-9]+" if level is None else str(level)
        wanted = re.escape(pattern).replace(re.escape("{country}"), names).replace(re.escape("{level}"), number)
        files = files.where(F.col("_metadata.file_path").rlike(f"[/_.=-]{wanted}(?:[/_.=-]|$)"))
    alone = F.array(F.struct("type", "properties", "geometry").cast(feature))
    rows = files.select(F.explode(F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(alone)).alias("f"))

    def value(column: str, name: str) -> Column:
        text = F.try_element_at("f.properties", F.lit(name))
        return (text.try_cast(types[column]) if column in types else text).alias(column)

    return rows.select(*[value(c, n) for c, n in properties.items()], F.col("f.geometry").alias("geometry"))


def boundary_edges(layer: DataFrame, unit: Sequence[str], geometry: str = "geometry") -> DataFrame:
    """One row per ring segment: ``<unit>, part, ring, pos, x1, y1, x2, y2``.

    Rings that do not end where they begin are closed.
    """
    rings = (
        layer.select(*unit, F.posexplode(parse_geometry(geometry)).alias("part", "__polygon"))
        .select(*unit, "part", F.posexplode("__polygon").alias("ring", "__ring"))
    )
    first = F.try_element_at("__ring", F.lit(1))
    is_open = first != F.try_element_at("__ring", F.lit(-1))
    closed = F.when(is_open, F.concat("__ring", F.array(first))).otherwise(F.col("__ring"))
    rings = rings.withColumn("__ring", closed)
    ends = F.arrays_zip(
        F.slice("__ring", F.lit(1), F.size("__ring") - 1).alias("a"),
        F.slice("__ring", F.lit(2), F.size("__ring") - 1).alias("b"),
    )
    return rings.select(*unit, "part", "ring", F.posexplode(ends).alias("pos", "__e")).select(
        *unit,
        "part",
        "ring",
        "pos",
        *[
            F.col("__e")[end][i].alias(f"{axis}{n}")
            for n, end in ((1, "a"), (2, "b"))
            for i, axis in enumerate("xy")
        ],
    )
