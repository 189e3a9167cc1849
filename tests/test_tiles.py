import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import hailgrid as hg
from tests.test_trips import frame, trip

WEST, SOUTH, SIDE = -74.375, 40.3, 0.8


@pytest.fixture(scope="module")
def points():
    rng = random.Random(6)
    busy = [(-73.98 + rng.gauss(0, 0.01), 40.75 + rng.gauss(0, 0.01)) for _ in range(400)]
    return busy + [(rng.uniform(WEST - 0.1, WEST + 0.9), rng.uniform(SOUTH - 0.1, SOUTH + 0.9)) for _ in range(200)] + [(WEST, SOUTH), (WEST + SIDE, SOUTH + SIDE)]


@pytest.fixture(scope="module")
def trips(spark, points):
    return frame(spark, *[trip(pickup_longitude=x, pickup_latitude=y, fare_amount=float(i)) for i, (x, y) in enumerate(points)])


def cells(points, zoom):
    out = []
    for x, y in points:
        if WEST <= x <= -73.575 and SOUTH <= y <= 41.1:
            step_x, step_y = (-73.575 - WEST) / 256, (41.1 - SOUTH) / 256
            out.append((min(int((x - WEST) / step_x), 255) >> (8 - zoom), min(int((y - SOUTH) / step_y), 255) >> (8 - zoom)))
    return out


def test_density_at_each_zoom(trips, points):
    got = {(r.zoom, r.x, r.y): r.density for r in hg.heatmap_tiles(trips).collect()}
    want = Counter()
    for zoom in range(3, 9):
        for x, y in cells(points, zoom):
            for i, a in enumerate((1, 4, 6, 4, 1)):
                for j, b in enumerate((1, 4, 6, 4, 1)):
                    if 0 <= x + i - 2 < 1 << zoom and 0 <= y + j - 2 < 1 << zoom:
                        want[zoom, x + i - 2, y + j - 2] += a * b / 256
    assert got == pytest.approx(dict(want))
    # The finest zoom is the plain heat map.
    plain = {(r.x, r.y): r.density for r in hg.heatmap(trips).collect()}
    assert plain == pytest.approx({(x, y): d for (zoom, x, y), d in got.items() if zoom == 8})


def test_one_scan(spark, trips, tmp_path):
    trips.write.parquet(f"{tmp_path}/trips")
    stored = spark.read.parquet(f"{tmp_path}/trips")
    for layer in (hg.heatmap_tiles(stored), hg.point_tiles(stored, most=5)):
        assert "FileScan" not in layer._jdf.queryExecution().executedPlan().toString()


def test_points_of_each_tile(trips, points):
    most = 12
    got = hg.point_tiles(trips, most=most, finest=6).collect()
    tiles = {}
    for r in got:
        tiles.setdefault((r.zoom, r.tile_x, r.tile_y), []).append(r)
    inside = [(x, y) for x, y in points if WEST <= x <= -73.575 and SOUTH <= y <= 41.1]
    for zoom in range(1, 7):
        counts = Counter(cells(inside, zoom))
        assert {k[1:]: len(v) for k, v in tiles.items() if k[0] == zoom} == {k: min(most, n) for k, n in counts.items()}
        for (z, x, y), rows in tiles.items():
            if z == zoom:
                assert {r.n_points for r in rows} == {counts[x, y]}
                if counts[x, y] <= most:
                    assert sorted((r.x, r.y) for r in rows) == sorted(p for p, c in zip(inside, cells(inside, zoom), strict=True) if c == (x, y))
    # A wider tile shows a part of what its tiles show.
    wide = {(r.x, r.y) for r in got if r.zoom == 3}
    assert wide <= {(r.x, r.y) for r in got if r.zoom == 6}


def test_nothing(spark, trips):
    assert hg.heatmap_tiles(trips.limit(0)).count() == 0 and hg.point_tiles(trips.limit(0)).count() == 0
    same = trips.limit(1).withColumn("n", F.explode(F.array(*[F.lit(i) for i in range(9)]))).drop("n")
    rows = hg.point_tiles(same, most=4, zooms=2).collect()
    assert len(rows) == 8 and {r.n_points for r in rows} == {9}
    with pytest.raises(ValueError):
        hg.heatmap_tiles(trips, finest=2, zooms=4)
