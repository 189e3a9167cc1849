import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

import hailgrid as hg
from checks import sample
from hailgrid.functions import geometry
from hailgrid.checkpoints import ensure_checkpoint_dir
from hailgrid.operators import estimate, matching
from hailgrid.operators.lookup import lookup
from hailgrid.operators.matching import window_stats
from tests.test_trips import frame, trip

PLACES = ["start_lon", "start_lat", "dest_lon", "dest_lat"]


@pytest.fixture(scope="module")
def city(spark):
    """Trips of which a third are at one place and second."""
    rng = random.Random(7)
    rows = [trip(fare_amount=float(i % 7)) for i in range(200)]
    for i in range(400):
        spot = {n: v + rng.randrange(-400, 400) / 10000 for n, v in (("pickup_longitude", -73.98), ("dropoff_longitude", -73.97))}
        spot |= {n: v + rng.randrange(-400, 400) / 10000 for n, v in (("pickup_latitude", 40.75), ("dropoff_latitude", 40.76))}
        rows.append(trip(**spot, time_of_day_sec=rng.randrange(1, 86400), fare_amount=float(i % 11), payment_type=i % 8))
    return rows


@pytest.fixture(scope="module")
def asked():
    rng = random.Random(8)
    rows = [(i, -73.98, 40.75, -73.97, 40.76, 36000) for i in range(60)]
    rows += [(100 + i, -73.98 + rng.randrange(-900, 900) / 10000, 40.75, -73.97, 40.76 + rng.randrange(-300, 300) / 10000, rng.randrange(86400)) for i in range(120)]
    return rows + [(900, None, 40.75, -73.97, 40.76, 36000), (901, -73.98, 40.75, -73.97, 40.76, None), (902, -70.0, 40.75, -73.97, 40.76, 36000)]


def brute_force(rows, request, area=None):
    names = [f.name for f in frame_schema()]
    _, lon, lat, dlon, dlat, second = request
    if None in request:
        return None
    for level in range(5):
        b, reach = 0.0041 * 2**level, 600 * 2**level
        fares = []
        for row in rows:
            t = dict(zip(names, row, strict=True))
            near = lon - b <= t["pickup_longitude"] <= lon + b and lat - b <= t["pickup_latitude"] <= lat + b
            near = near and dlon - b <= t["dropoff_longitude"] <= dlon + b and dlat - b <= t["dropoff_latitude"] <= dlat + b
            if near and second - reach <= t["time_of_day_sec"] <= second + reach:
                fares.append(t["fare_amount"])
        if fares:
            return level, len(fares), min(fares), sum(fares)
    return None


def frame_schema():
    from hailgrid.schema import STAGED_SCHEMA

    return STAGED_SCHEMA


# Broadcast; shuffle; shuffle with crowded cells of trips and of windows.
LIMITS = [{}, {"broadcast_cells": 0}, {"broadcast_cells": 0, "hot_trips": 20, "hot_windows": 5, "hot_pairs": 50}]


@pytest.mark.parametrize("limits", LIMITS)
def test_estimates_equal_brute_force(spark, city, asked, limits):
    requests = spark.createDataFrame(asked, "request_id int, start_lon double, start_lat double, dest_lon double, dest_lat double, start_sec int")
    answers = {r.request_id: r for r in hg.estimate(frame(spark, *city), requests, ["fare_amount"], **limits).collect()}
    assert len(answers) == len(asked)
    for request in asked:
        expected, got = brute_force(city, request), answers[request[0]]
        if expected is None:
            assert (got.matched, got.level, got["count"], got.duration_avg) == (False, None, 0, 0.0)
        else:
            assert (got.level, got["count"], got.fare_amount_min, got.fare_amount_total) == expected and got.matched


@pytest.mark.parametrize("limits", LIMITS)
def test_window_statistics_equal_a_plain_join(spark, city, asked, limits):
    trips = frame(spark, *city)
    windows = spark.createDataFrame(asked[:-3], "id int, start_lon double, start_lat double, dest_lon double, dest_lat double, sec int")
    window = hg.Window(
        geometry.search_box(F.col("start_lon"), F.col("start_lat"), 0.03),
        geometry.circle_area(F.col("dest_lon"), F.col("dest_lat"), 0.02),
        F.col("sec") - 5000,
        F.col("sec") + 1000,
    )
    got = hg.window_stats(windows, window, trips, ["id"], ["payment_type"], **limits)
    pairs = windows.join(trips, window.covers_trip())
    plain = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("payment_type") == 3).alias("payment_type_3"))
    columns = ["id", "count", "payment_type_3"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))


def test_no_requests(spark, city):
    requests = spark.createDataFrame([], "request_id int, start_lon double, start_lat double, dest_lon double, dest_lat double, start_sec int")
    assert hg.estimate(frame(spark, *city), requests).count() == 0


RESPONSES = {
    "box": '{"results":[{"types":["street_address"],"formatted_address":"1 A St","address_components":[{"long_name":"A","short_name":"a","types":[]}],"geometry":{"bounds":{"northeast":{"lat":40.76,"lng":-73.97},"southwest":{"lat":40.74,"lng":-73.99}},"location":{"lat":1.0,"lng":2.0}}}]}',
    "circle": '{"results":[{"types":["route"],"formatted_address":"no","geometry":{"location":{"lat":40.76,"lng":-73.97}}},{"types":["x","street_address"],"formatted_address":"2 B St","address_components":[],"geometry":{}}]}',
    "nowhere": '{"results":[{"types":["route"],"formatted_address":"no","geometry":{}}]}',
    "empty": '{"results":[],"status":"ZERO_RESULTS"}',
}


@pytest.mark.parametrize("limits", LIMITS)
def test_addresses(spark, city, limits):
    responses = spark.createDataFrame(list(RESPONSES.items()), "key string, body string")
    places = {r.key: r for r in hg.geocode(responses).collect()}
    assert tuple(places["box"].area)[:5] == (-73.99, 40.74, -73.97, 40.76, None)
    assert places["circle"].area.x == -73.97 and places["circle"].address_info.formatted_address == "2 B St"
    assert places["nowhere"].area is None and places["empty"].area is None
    assert places["empty"].address_info.asDict() == {"formatted_address": "Unknown Address", "address_components": []}
    requests = spark.createDataFrame(
        [(1, "box", "circle", 36000), (2, "box", "circle", 36700), (3, "box", "nowhere", 36000), (4, "box", "missing", 36000), (5, None, "box", 1)],
        "request_id int, start_address string, dest_address string, start_sec int",
    )
    located = hg.geocode_requests(requests, responses)
    answers = {r.request_id: r for r in hg.estimate_address(frame(spark, *city), located, ["fare_amount"], **limits).collect()}
    assert [answers[i].matched for i in range(1, 6)] == [True, True, False, False, False]
    assert (answers[1].level, answers[2].level) == (0, 1)
    near = frame(spark, *city).where(hg.trip_filter(35400, 36600, hg.box(-73.99, 40.74, -73.97, 40.76), hg.circle(-73.97, 40.76)))
    assert answers[1]["count"] == near.count() >= 200


def test_lookup_of_a_large_table(spark, monkeypatch):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 20).alias("k"))
    table = spark.range(15).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = lookup(rows, table, ["k"], 15)
    for hot_rows in (1_000_000, 100):
        large = lookup(rows, table, ["k"], 15, broadcast_rows=10, hot_rows=hot_rows)
        assert sorted(map(str, small.collect())) == sorted(map(str, large.select(small.columns).collect()))


def test_checkpoint_folder_is_the_shared_one(spark):
    ensure_checkpoint_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()


def test_replies(spark, city):
    requests = spark.createDataFrame(
        [(1, -73.98, 40.75, -73.97, 40.76, "2016-05-04T10:00:00.000Z"), (2, None, 40.75, -73.97, 40.76, "2016-05-04T10:00:00.000Z")],
        "request_id int, start_lon double, start_lat double, dest_lon double, dest_lat double, start_time string",
    )
    fields = ["trip_distance", "fare_amount", "tolls_amount"]
    answers = hg.estimate(frame(spark, *city), hg.with_departure(requests), fields)
    short = {r.request_id: r.reply for r in hg.estimate_json(answers, full=False).collect()}
    assert short == {1: '[["2016-05-04T10:00:00Z",600.0]]', 2: '[["2016-05-04T10:00:00Z",0]]'}
    card = hg.trip_card(answers).collect()
    assert [(r.request_id, r.arrival, r.tolls) for r in card] == [(1, "2016-05-04T10:10:00Z", 0.0)]


def test_addresses_collect_only_the_asked_steps_of_the_day(spark, monkeypatch):
    trips = frame(spark, *[trip(time_of_day_sec=s, fare_amount=float(s)) for s in range(30, 86400, 60) if not 60000 <= s < 70000])
    box = "named_struct('xmin',-80D,'ymin',30D,'xmax',-70D,'ymax',50D,'x',cast(null as double),'y',cast(null as double),'radius',cast(null as double))"
    seconds = [0, 600, 36000, 36599, 65000, 86399]
    asked = spark.createDataFrame([(i, "a", "b", s) for i, s in enumerate(seconds)], "request_id int, start_address string, dest_address string, start_sec long")
    asked = asked.selectExpr("*", f"{box} as start_area", f"{box} as dest_area")
    collected = []

    def counted(*args, **how):
        stats = window_stats(*args, **how)
        collected.append(stats.count())
        return stats

    monkeypatch.setattr(estimate, "window_stats", counted)
    found = {r.request_id: (r["level"], r["count"], r.fare_amount_total) for r in hg.estimate_address(trips, asked, ["fare_amount"]).collect()}
    for i, second in enumerate(seconds):
        level, near = next((k, n) for k in range(5) if (n := [s for s in range(30, 86400, 60) if not 60000 <= s < 70000 and abs(s - second) <= 600 * 2**k]))
        assert found[i] == (level, len(near), float(sum(near)))
    # Of the 1273 seconds with trips: steps 0-2, 59-61 and 142-143 of the day, then those around the one without trips near it.
    assert collected == [10 * 8, sum(55200 <= s < 75000 for s in range(30, 86400, 60) if not 60000 <= s < 70000)]


def test_rows_are_not_looked_up_to_be_counted(spark):
    plain = spark.createDataFrame([(i % 7 if i % 5 else None, i) for i in range(60)], "k int, i int")
    table = spark.createDataFrame([(k, f"t{k}") for k in range(6)], "k int, t string")
    # Work that must wait for the result: to count the keys, the given rows are enough.
    dear = plain.withColumn("x", F.assert_true(F.col("i") < 0)).where("x is null")
    lookup(dear, table, ["k"], 6, broadcast_rows=0, hot_rows=9, counted=plain)
    found = lookup(plain, table, ["k"], 6, broadcast_rows=0, hot_rows=9, counted=plain)
    assert sorted(found.collect(), key=lambda r: r.i) == sorted(lookup(plain, table, ["k"], 6).collect(), key=lambda r: r.i)


def test_no_more_hot_keys_than_the_bound(spark, monkeypatch):
    from hailgrid.operators import lookup as module

    monkeypatch.setattr(module, "HOT_KEYS", 3)
    rows = spark.createDataFrame([(k, k * 100 + i) for k in range(8) for i in range(2 + 4 * (k < 2))], "k int, i int")
    table = spark.createDataFrame([(k, f"t{k}") for k in range(7)], "k int, t string")
    found = lookup(rows, table, ["k"], 7, broadcast_rows=0, hot_rows=1)
    assert sorted((r.i, r.t) for r in found.collect() if r.t) == [(r.i, f"t{r.k}") for r in rows.orderBy("i").collect() if r.k < 7]
    assert found.count() == rows.count()


def test_requests_without_trips_in_reach_are_not_matched(spark, city, monkeypatch):
    listed = []

    def counted(windows, *args, **how):
        listed.append(windows.count() if any(n for _, n, _ in how["groups"]) else 0)
        return window_stats(windows, *args, **how)

    monkeypatch.setattr(estimate, "window_stats", counted)
    names = "request_id int, start_lon double, start_lat double, dest_lon double, dest_lat double, start_sec int"
    far = [(0, -70.0, 40.75, -73.97, 40.76, 36000), (1, -74.3, 40.4, -74.3, 40.4, 36000), (2, -73.98, 40.75, -73.97, 40.76, 36000)]
    answers = {r.request_id: r.matched for r in hg.estimate(frame(spark, *city), spark.createDataFrame(far, names)).collect()}
    assert answers == {0: False, 1: False, 2: True} and listed == [1]


def test_sizes_of_few_windows_are_broadcast(spark, city):
    rows = [(i, -73.98 + i / 1000, 0.0041 if i % 10 else 0.05) for i in range(40)]
    windows = spark.createDataFrame(rows, "id int, x double, half double")
    window = hg.Window(geometry.search_box(F.col("x"), F.lit(40.75), F.col("half")), geometry.search_box(F.lit(-73.97), F.lit(40.76), F.lit(0.03)))
    trips = frame(spark, *city)
    stats = window_stats(windows, window, trips, ["id"], ["fare_amount"], broadcast_cells=400)
    plain = windows.join(trips, window.covers_trip()).groupBy("id").agg(F.count(F.lit(1)).alias("count"), F.sum("fare_amount").alias("fare_amount_total"))
    columns = ["id", "count", "fare_amount_total"]
    assert sorted(map(tuple, stats.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))
    # Four windows of one size, 36 of the other: no trip is listed for both.
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array(" not in plan


def _around(spark, asked):
    """Windows of two sizes, and the window."""
    windows = spark.createDataFrame([r for r in asked if None not in r], "id int, start_lon double, start_lat double, dest_lon double, dest_lat double, start_sec int")
    grown = F.when(F.col("id") % 2 == 0, 0.02).otherwise(0.004)
    boxes = [geometry.search_box(F.col(f"{end}_lon"), F.col(f"{end}_lat"), grown) for end in ("start", "dest")]
    return windows, hg.Window(*boxes, F.col("start_sec") - 5000, F.col("start_sec") + 5000)


@pytest.mark.parametrize("by", [(), ["time_of_day_sec"]])
@pytest.mark.parametrize("limits", [{"broadcast_cells": 0}, {"broadcast_cells": 0, "hot_trips": 150}])
def test_blocks_of_trips_equal_a_plain_join(spark, city, asked, monkeypatch, by, limits):
    for name, value in (("BLOCKS_FROM", 0), ("BLOCK_TRIPS", 1), ("HEAVY_TRIPS", 20)):
        monkeypatch.setattr(matching, name, value)
    parts, seen = [], matching.blocks
    monkeypatch.setattr(matching, "blocks", lambda *a, **k: parts.append(a) or seen(*a, **k))
    trips = frame(spark, *city)
    windows, window = _around(spark, asked)
    columns = ["id", *by, "count", "fare_amount_total", "fare_amount_min"]
    got = window_stats(windows, window, trips, ["id"], ["fare_amount"], by=by, **limits).select(columns).collect()
    plain = windows.join(trips, window.covers_trip()).groupBy("id", *by).agg(F.count(F.lit(1)).alias("count"), F.sum("fare_amount").alias("fare_amount_total"), F.min("fare_amount").alias("fare_amount_min"))
    assert parts
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain.select(columns).collect()))
    assert len(got) > 50


def _largest_method(frame):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain("codegen")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue()))


@pytest.fixture
def not_adaptive(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before)


@pytest.mark.parametrize("broadcast_cells", [0, matching.BROADCAST_CELLS])
def test_windows_of_many_sizes_have_small_methods(spark, city, asked, not_adaptive, broadcast_cells):
    windows = spark.createDataFrame([r for r in asked if None not in r], "id int, start_lon double, start_lat double, dest_lon double, dest_lat double, start_sec int")
    windows = windows.withColumn("_try", F.col("id") % 5)
    groups = [((level + 1,) * 3, 30, 960) for level in range(5)]
    stats = window_stats(
        windows, estimate._search(F.col("_try")), frame(spark, *city), ["id"], ["fare_amount", "payment_type"], by={"level": estimate._trip_level()}, groups=groups, n_trips=600, broadcast_cells=broadcast_cells
    )
    assert _largest_method(stats) < 8000


def test_crowded_cells_are_cut_to_no_more_parts_than_spread_the_work(spark):
    trips = spark.range(40_000).select((F.col("id") % 4).alias("cell"))
    windows = spark.range(400).select((F.col("id") % 4).alias("cell"))
    hot = matching._hot_cells(trips, 40_000, windows, 400, 1, 1, 1)
    parts = hot.agg(F.sum(F.col("trip_parts") * F.col("window_parts"))).first()[0]
    # Without a bound a cell would have a part for each pair.
    assert parts < 400 * 40_000 / 4 / 4
    assert hot.agg(F.max("trip_parts")).first()[0] <= 1 / matching.LEAST_PIECE


def test_trips_are_read_by_a_small_method(spark, tmp_path, not_adaptive, monkeypatch):
    types = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"
    rows = spark.range(50).selectExpr("id", "1", "id * 7", "id * 3", "1.0", "2.0", "0.1", "0.2", "'R'", "timestamp'1996-01-01'").collect()
    spark.createDataFrame(rows, types).write.parquet(f"{tmp_path}/lineitem.parquet")
    # Larger tables aren't dealt out before they are filtered.
    monkeypatch.setattr(sample, "SPREAD_BYTES", 0)
    trips = hg.valid_trips(sample.trips(spark, str(tmp_path), spread=True))
    near = F.lit(True)
    for name in matching.PLACE:
        near = near & F.col(name).between(-100, 90_000)
    keyed = trips.where(near).select("fare_amount", *[F.floor(F.col(n) / size).alias(f"{n}_{size}") for n in matching.PLACE for size in (1, 2, 4)])
    assert _largest_method(keyed) < 8000
    assert keyed.count() > 10
