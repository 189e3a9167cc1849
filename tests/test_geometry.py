import math

import pytest
from pyspark.sql import functions as F

import hailgrid as hg
from hailgrid.functions import geometry, grid


@pytest.fixture(scope="module")
def points(spark):
    steps = [(i / 20, j / 20) for i in range(-30, 31) for j in range(-30, 31)]
    return spark.createDataFrame(steps, "x double, y double").cache()


def inside(points, area):
    return {(r.x, r.y) for r in points.where(area.covers("x", "y")).select("x", "y").collect()}


def test_box_and_boundary(points):
    got = inside(points, hg.box(-0.5, -0.25, 0.5, 0.25))
    assert (0.5, 0.25) in got and (-0.5, -0.25) in got and (0.55, 0.0) not in got
    assert len(got) == 21 * 11


def test_general_form_equals_convex_form(points):
    area = hg.circle(0.0, 0.0, 1.0)
    ring = area.parts[0]
    assert ring.turn() == 1
    x, y = F.col("x"), F.col("y")
    general = points.where(geometry.edges_cover(geometry._edge_array(ring.edges), x, y))
    assert {(r.x, r.y) for r in general.collect()} == inside(points, area)
    clockwise = hg.polygon(list(reversed(ring.rings[0])))
    assert inside(points, clockwise) == inside(points, area)


def test_row_circle_equals_query_circle(points):
    area = geometry.circle_area(F.lit(0.1), F.lit(-0.2), 0.9)
    got = {(r.x, r.y) for r in points.where(area.covers(F.col("x"), F.col("y"))).collect()}
    assert got == inside(points, hg.circle(0.1, -0.2, 0.9))


def test_polygon_with_hole_and_notch(points):
    shell = [(-1, -1), (1, -1), (1, 1), (0, 0), (-1, 1)]
    hole = [(-0.6, -0.6), (-0.2, -0.6), (-0.2, -0.2), (-0.6, -0.2)]
    got = inside(points, hg.polygon(shell, hole))
    assert (0.0, 0.0) in got  # notch tip is boundary
    assert (0.0, 0.5) not in got and (-0.4, -0.4) not in got
    assert (-0.2, -0.2) in got and (0.9, 0.9) in got and (0.95, 0.9) in got


def test_parts(points):
    a, b = hg.box(-1, -1, -0.5, -0.5), hg.polygon([(0.5, 0.5), (1, 0.5), (0.75, 1)])
    both = a | b
    assert inside(points, both) == inside(points, a) | inside(points, b)
    assert both.envelopes == [(-1, -1, -0.5, -0.5), (0.5, 0.5, 1, 1)]
    assert both.envelope == (-1, -1, 1, 1)


def test_text(spark):
    box = geometry.search_box(F.lit(-74.0), F.lit(40.5), 0.5)
    circle = geometry.circle_area(F.lit(0.0), F.lit(0.0), 1.0)
    row = spark.range(1).select(geometry.area_wkt(box).alias("b"), geometry.area_wkt(circle).alias("c")).first()
    assert row.b == "POLYGON ((-74.5 40, -73.5 40, -73.5 41, -74.5 41, -74.5 40))"
    corners = row.c.removeprefix("POLYGON ((").removesuffix("))").split(", ")
    assert len(corners) == 21 and corners[0] == corners[-1] == "1 0"
    assert math.isclose(float(corners[5].split()[1]), 1.0)


def test_grid(spark):
    rows = spark.createDataFrame(
        [(-74.375, 40.3, -80.0, 50.0, 0), (-73.575, 41.1, -73.975, 40.7, 86399)],
        "pickup_longitude double, pickup_latitude double, dropoff_longitude double, dropoff_latitude double, time_of_day_sec long",
    )
    for bias, (space, time) in grid.BIAS_BITS.items():
        first, second = rows.select(*grid.grid_cells(bias.upper())).collect()
        assert tuple(first) == (0, 0, 0, 2**space - 1, 0)
        assert second.pickup_x == second.pickup_y == 2**space - 1
        assert second.dropoff_y == 2 ** (space - 1) and second.time_cell == 86399 * 2**time // 86400
    with pytest.raises(ValueError, match="unknown bias"):
        grid.grid_cells("none")
