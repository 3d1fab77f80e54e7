"""Spatial operators against brute force."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from panelspark.operators import spatial as S
from panelspark.plans.raster import raster_panel
from panelspark.sources.boundaries import boundary_edges

EDGES = "unit_id string, x1 double, y1 double, x2 double, y2 double"


def ring(unit, points):
    return [(unit, *a, *b) for a, b in zip(points, points[1:] + points[:1])]


def covers(edges, px, py):
    """Even-odd rule plus border, straight from the definition."""
    odd = False
    for _, x1, y1, x2, y2 in edges:
        if (x2 - x1) * (py - y1) == (y2 - y1) * (px - x1) and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
            return True
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def star(unit, cx, cy, n, rng):
    """A ragged polygon: its border runs back and forth through many tiles."""
    pts = []
    for k in range(n):
        r = rng.uniform(0.2, 1.6)
        pts.append((cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)))
    return ring(unit, pts)


SHAPES = (
    ring("concave", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)])
    + ring("holed", [(5.0, 0.0), (9.0, 0.0), (9.0, 4.0), (5.0, 4.0)])
    + ring("holed", [(6.0, 1.0), (6.0, 3.0), (8.0, 3.0), (8.0, 1.0)])
    + ring("parts", [(-3.0, -3.0), (-2.0, -3.0), (-2.0, -2.0)])
    + ring("parts", [(-6.0, -3.0), (-5.0, -3.0), (-5.0, -2.0)])
    + ring("neighbour", [(9.0, 0.0), (10.0, 0.0), (10.0, 4.0), (9.0, 4.0)])
)


def exact_side(edge, px, py):
    x1, y1, x2, y2, px, py = (Fraction(v) for v in (*edge, px, py))
    return (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)


def test_no_point_falls_between_neighbours(spark):
    """2,000 points along one sloped border, which its two units walk in opposite directions."""
    a, b = (0.1, 0.3), (3.7, 1.9)
    units = ring("low", [a, b, (3.9, -1.0), (0.2, -1.1)]) + ring("high", [b, a, (-0.4, 3.0), (3.5, 4.0)])
    points = []
    for k in range(2000):
        t = k / 1999
        points.append((k, a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    df = spark.createDataFrame(points, "pid long, longitude double, latitude double")
    got = {}
    for pid, unit in found(S.assign_units(df, spark.createDataFrame(units, EDGES), how="inner")):
        got.setdefault(pid, set()).add(unit)
    for k, x, y in points:
        side = exact_side((*a, *b), x, y)
        inside = a[0] <= x <= b[0] and a[1] <= y <= b[1]
        if inside:
            assert got[k] == ({"low", "high"} if side == 0 else {"high"} if side > 0 else {"low"}), k
    assert any(len(u) == 2 for u in got.values())


def test_points_exactly_on_a_border_are_in_both(spark):
    a, b = (0.25, 3.5), (1.75, 2.75)
    units = ring("low", [b, a, (0.0, 0.0)]) + ring("high", [a, b, (4.0, 5.0)])
    points = [(k, a[0] + k / 64 * 1.5, a[1] - k / 64 * 0.75) for k in range(65)]
    df = spark.createDataFrame(points, "pid long, longitude double, latitude double")
    got = found(S.assign_units(df, spark.createDataFrame(units, EDGES), how="inner"))
    assert got == sorted((k, u) for k in range(65) for u in ("low", "high"))


def test_orientation_is_exact(spark):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        x1, y1, dx, dy = (rng.uniform(-180, 180) for _ in range(4))
        t = rng.choice([0.5, 0.25, rng.random()])
        rows.append((k, x1, y1, x1 + dx, y1 + dy, x1 + t * dx, y1 + t * dy))
    rows.append((400, 0.1, 0.1, 0.3, 0.3, 0.2, 0.2))
    rows.append((401, 1e-30, 1e-30, 1e10, 1e10, 1.0, 1.0))
    df = spark.createDataFrame(rows, "k long, x1 double, y1 double, x2 double, y2 double, px double, py double")
    edge = F.struct("x1", "y1", "x2", "y2")
    got = {r["k"]: r["s"] for r in df.select("k", S.orientation(edge, F.col("px"), F.col("py")).alias("s")).collect()}
    for k, x1, y1, x2, y2, px, py in rows:
        side = exact_side((x1, y1, x2, y2), px, py)
        assert got[k] == (side > 0) - (side < 0), k


def found(df):
    return sorted((r["pid"], r["unit_id"]) for r in df.select("pid", "unit_id").collect())


def test_hand_made_shapes(spark):
    edges = spark.createDataFrame(SHAPES, EDGES)
    points = {"concave side": (2.0, 3.0), "in hole": (7.0, 2.0), "in part": (-2.2, -2.9), "shared border": (9.0, 2.0), "outside": (50.0, 50.0)}
    df = spark.createDataFrame([(k, *v) for k, v in points.items()], "pid string, longitude double, latitude double")
    got = found(S.assign_units(df, edges, how="left"))
    assert got == sorted(
        [("concave side", None), ("in hole", None), ("in part", "parts"), ("shared border", "holed"), ("shared border", "neighbour"), ("outside", None)]
    )


@pytest.mark.parametrize("tile", [0.25, 0.37, 3.0])
def test_points_equal_brute_force(spark, tile):
    rng = random.Random(11)
    shapes = SHAPES + star("star1", 0.3, -1.1, 60, rng) + star("star2", -4.0, 3.3, 41, rng)
    by_unit = {}
    for e in shapes:
        by_unit.setdefault(e[0], []).append(e)
    points = [(k, rng.uniform(-7, 11), rng.uniform(-4, 6)) for k in range(600)]
    # Lattice points sit on borders, corners and tile lines.
    points += [(1000 + k, float(k % 17 - 6), float(k // 17 - 4)) for k in range(170)]
    want = sorted((k, u) for k, x, y in points for u, es in by_unit.items() if covers(es, x, y))
    df = spark.createDataFrame(points, "pid int, longitude double, latitude double")
    edges = spark.createDataFrame(shapes, EDGES)
    assert found(S.assign_units(df, edges, how="inner", tile=tile)) == want
    # Beyond the broadcast bound the same points are matched by shuffle.
    assert found(S.assign_units(df, edges, how="inner", tile=tile, max_segments=0)) == want
    left = S.assign_units(df, edges, how="left", tile=tile, max_segments=0)
    assert left.columns == S.assign_units(df, edges, how="left", tile=tile).columns == [*df.columns, "unit_id"]
    assert left.select("pid").distinct().count() == len(points)


def test_points_are_not_shuffled(spark):
    edges = spark.createDataFrame(SHAPES, EDGES)
    df = spark.range(100).select(F.col("id").alias("pid"), (F.col("id") / 10).alias("longitude"), F.lit(1.0).alias("latitude"))
    plan = S.assign_units(df, edges)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_index_size_follows_the_boundary(spark):
    """A coastline far right of a tile leaves its ends, not its vertices, in the tile."""
    coast = [(5.0 + 0.01 * (k % 2), k / 500) for k in range(501)]
    edges = spark.createDataFrame(ring("c", [(0.0, 0.0), *coast, (0.0, 1.0)]), EDGES)
    index = S.unit_index(edges, tile=0.25).where("tx < 15 and segments is not null")
    assert index.select(F.max(F.size("heights"))).first()[0] <= 4


def test_boxes_equal_brute_force(spark):
    rng = random.Random(5)
    shapes = SHAPES + star("star", 0.3, -1.1, 30, rng) + ring("tiny", [(0.31, 0.31), (0.33, 0.31), (0.32, 0.33)])
    boxes = [(k, x, y, x + 0.5, y + 0.5) for k, (x, y) in enumerate((rng.uniform(-7, 10), rng.uniform(-4, 5)) for _ in range(150))]
    boxes.append((999, 0.0, 0.0, 1.0, 1.0))

    def meets(e, b):
        _, x1, y1, x2, y2 = e
        _, a, c, d, f = b
        if max(x1, x2) < a or min(x1, x2) > d or max(y1, y2) < c or min(y1, y2) > f:
            return False
        sides = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (a, d) for y in (c, f)]
        return not (min(sides) > 0 or max(sides) < 0)

    by_unit = {}
    for e in shapes:
        by_unit.setdefault(e[0], []).append(e)
    want = sorted(
        (b[0], u) for b in boxes for u, es in by_unit.items() if any(meets(e, b) for e in es) or covers(es, b[1], b[2])
    )
    df = spark.createDataFrame(boxes, "gid int, xmin double, ymin double, xmax double, ymax double")
    got = S.box_units(df, spark.createDataFrame(shapes, EDGES))
    assert sorted(map(tuple, got.select("gid", "unit_id").collect())) == want


def test_zonal_layouts_agree(spark):
    edges = spark.createDataFrame(SHAPES, EDGES)
    rng = random.Random(2)
    cells = [(k, rng.uniform(-6, 10), rng.uniform(-3, 4), [rng.choice([-9999.0, 1.0, 2.0, 5.0]) for _ in range(3)]) for k in range(400)]
    wide = spark.createDataFrame(cells, "cell_id int, x double, y double, value array<double>")
    bands = spark.createDataFrame([(0, "m0"), (1, "m1"), (2, "m2")], "band int, ymd string")
    long = wide.select("cell_id", "x", "y", F.posexplode("value").alias("band", "value")).join(bands, "band")
    a = S.zonal_mean(wide, edges, bands=bands).select("unit_id", "ymd", "value")
    b = S.zonal_mean(long, edges).select("unit_id", "ymd", "value")

    def table(df):
        return {(r[0], r[1]): round(r[2], 9) for r in df.collect()}

    assert table(a) == table(b) and len(table(a)) == 12


def test_climatology_propagates_null(spark):
    df = spark.sql("SELECT 'u' AS u, d AS ymd, v AS value FROM VALUES (DATE '2000-01-01', 1.0D), (DATE '2001-01-01', NULL), (DATE '2000-02-01', 3.0D) AS t(d, v)")
    assert {r["month"]: r["value"] for r in S.climatology(df, ["u"]).collect()} == {1: None, 2: 3.0}


def test_sinusoidal(spark):
    df = spark.createDataFrame([(90.0, 60.0)], "x double, y double")
    r = S.to_sinusoidal(df, [("x", "y")]).first()
    assert r["x"] == pytest.approx(S.SINUSOIDAL_RADIUS * math.pi / 2 * 0.5)
    assert r["y"] == pytest.approx(S.SINUSOIDAL_RADIUS * math.pi / 3)


def test_geojson_edges(spark):
    text = '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}'
    df = spark.createDataFrame([("u", text)], "unit_id string, geometry string")
    rows = boundary_edges(df, ["unit_id"]).orderBy("part", "pos").collect()
    assert [(r["part"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in rows[:2]] == [(0, 0.0, 0.0, 1.0, 0.0), (0, 1.0, 0.0, 1.0, 1.0)]
    assert len(rows) == 6


def test_geojson_kinds(spark):
    """Features and collections count, open rings are closed, no geometry gives no edge."""
    square = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}'
    texts = {
        "open": square,
        "feature": '{"type":"Feature","properties":{},"geometry":' + square + "}",
        "collection": '{"type":"GeometryCollection","geometries":[' + square + "," + square + "]}",
        "empty": '{"type":"Feature","properties":{},"geometry":null}',
        "null": None,
    }
    df = spark.createDataFrame(list(texts.items()), "unit_id string, geometry string")
    counts = {r["unit_id"]: r["count"] for r in boundary_edges(df, ["unit_id"]).groupBy("unit_id").count().collect()}
    assert counts == {"open": 4, "feature": 4, "collection": 8}
    last = boundary_edges(df.where("unit_id = 'open'"), ["unit_id"]).where("pos = 3").first()
    assert (last["x1"], last["y1"], last["x2"], last["y2"]) == (0.0, 1.0, 0.0, 0.0)


def test_geojson_other_shapes_raise(spark):
    df = spark.createDataFrame([("p", '{"type":"Point","coordinates":[1,2]}')], "unit_id string, geometry string")
    with pytest.raises(Exception, match="no polygon geometry"):
        boundary_edges(df, ["unit_id"]).collect()


def test_admin_layer(spark):
    base = spark.createDataFrame(
        [("A", "1", "State"), ("A", "2", "Water body"), ("A", "3", None), ("B", "4", "State")], "NAME_0 string, NAME_1 string, ENGTYPE_1 string"
    )
    alt = spark.createDataFrame([("x", "5")], "CNTRYNAMEE string, DHSREGEN string")
    names = {"CNTRYNAMEE": "NAME_0", "DHSREGEN": "NAME_1"}
    out = S.admin_layer(base, ["A"], [S.replacement_layer(alt, names), S.replacement_layer(alt, names, "Fixed")])
    assert sorted(map(tuple, out.collect())) == [("A", "1"), ("Fixed", "5"), ("x", "5")]


def test_raster_panel_by_file_name_and_projection(spark):
    edges = spark.createDataFrame(SHAPES, EDGES)
    cells = spark.createDataFrame(
        [(1, 1.0, 0.5, "t.August.2001.tif", 4.0), (2, 1.2, 0.5, "t.August.2001.tif", 6.0), (3, 1.0, 0.5, "t.April.2001.tif", -9999.0)],
        "cell_id int, x double, y double, file string, value double",
    )
    plain = raster_panel(cells, edges, ["unit_id"], file_name="file")
    got = sorted((r["unit_id"], str(r["ymd"]), r["value"]) for r in plain.collect())
    assert got == [("concave", "2001-04-01", None), ("concave", "2001-08-01", 5.0)]
    metres = S.to_sinusoidal(cells, [("x", "y")])
    moved = raster_panel(metres, edges, ["unit_id"], file_name="file", sinusoidal=True, tile=30000.0)
    assert sorted((r["unit_id"], str(r["ymd"]), r["value"]) for r in moved.collect()) == got
    with pytest.raises(ValueError, match="metres"):
        raster_panel(metres, edges, ["unit_id"], file_name="file", sinusoidal=True)


def crosses(a, b):
    def side(e, x, y):
        s = exact_side(e, x, y)
        return (s > 0) - (s < 0)

    p, q = a[1:], b[1:]
    apart = any(max(p[k], p[k + 2]) < min(q[k], q[k + 2]) or max(q[k], q[k + 2]) < min(p[k], p[k + 2]) for k in (0, 1))
    return not apart and side(p, *q[:2]) * side(p, *q[2:]) <= 0 and side(q, *p[:2]) * side(q, *p[2:]) <= 0


@pytest.mark.parametrize("tile", [0.25, 1.0])
def test_polygon_pairs(spark, tile):
    rng = random.Random(6)
    cells = [e for k in range(30) for e in star(f"c{k}", rng.uniform(-4, 10), rng.uniform(-4, 5), rng.choice([3, 4, 7]), rng)]
    cells += ring("inner", [(0.5, 0.2), (0.7, 0.2), (0.6, 0.4)]) + ring("hole", [(6.5, 1.5), (6.9, 1.5), (6.7, 1.9)])
    cells += ring("around", [(-9.0, -9.0), (12.0, -9.0), (12.0, 9.0), (-9.0, 9.0)]) + ring("touch", [(4.0, 0.0), (4.5, -1.0), (4.5, 1.0)])
    mine = spark.createDataFrame(cells, EDGES.replace("unit_id", "cell"))
    got = sorted(tuple(r) for r in S.polygon_pairs(mine, spark.createDataFrame(SHAPES, EDGES), ["cell"], ["unit_id"], tile).collect())
    want = set()
    for c in {e[0] for e in cells}:
        for u in {e[0] for e in SHAPES}:
            left, right = [e for e in cells if e[0] == c], [e for e in SHAPES if e[0] == u]
            if (
                any(crosses(a, b) for a in left for b in right)
                or any(covers(right, *e[1:3]) for e in left)
                or any(covers(left, *e[1:3]) for e in right)
            ):
                want.add((c, u))
    assert got == sorted(want) and ("inner", "concave") in want and ("hole", "holed") not in want and ("touch", "concave") in want
