import json

import pytest
from pyspark.sql import functions as F

import hailgrid as hg
from hailgrid.operators import estimate as est
from hailgrid.operators.address_cache import geocode_with_store, kept_answers
from hailgrid.operators.trip_info import REPLY_FIELDS, trip_info, trip_info_json
from tests.test_requests import RESPONSES, asked, city  # noqa: F401
from tests.test_trips import frame

REQUESTS = "request_id int, start_lon double, start_lat double, dest_lon double, dest_lat double, start_address string, dest_address string, start_time string"
TEN = "2016-05-04T10:00:00.000Z"
PLACE = (-73.98, 40.75, -73.97, 40.76)


@pytest.fixture(scope="module")
def requests(spark):
    rows = [
        (1, *PLACE, None, None, TEN),
        (2, None, None, None, None, "box", "circle", TEN),
        (3, *PLACE, "nowhere", "nowhere", TEN),
        (4, -73.98, None, -73.97, 40.76, "box", "circle", TEN),
        (5, None, None, None, None, "box", "", TEN),
        (6, None, None, None, None, "box", "missing", TEN),
        (7, *PLACE, None, None, "soon"),
        (8, *PLACE, None, None, None),
        (9, 10.0, 10.0, 10.0, 10.0, None, None, TEN),
        (1, *PLACE, None, None, TEN),
    ]
    return spark.createDataFrame(rows, REQUESTS).withColumn("kept", F.lit("yes"))


@pytest.fixture(scope="module")
def responses(spark):
    known = [*RESPONSES.items(), ("-73.98,40.75", RESPONSES["box"]), ("10,10", RESPONSES["empty"])]
    return spark.createDataFrame(known, "key string, body string")


def test_each_kind_is_answered_in_one_plan(spark, city, requests, responses):  # noqa: F811
    trips = frame(spark, *city)
    rows = trip_info(trips, requests, responses).collect()
    assert sorted(r.request_id for r in rows) == [1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    by_id = {r.request_id: r for r in rows}
    kinds = {i: by_id[i].kind for i in range(1, 10)}
    assert kinds == {1: "coordinates", 2: "addresses", 3: "coordinates", 4: "addresses", 5: "neither", 6: "addresses", 7: "coordinates", 8: "coordinates", 9: "coordinates"}
    assert [i for i in range(1, 10) if by_id[i].matched] == [1, 2, 3, 4]
    assert {r.kept for r in rows} == {"yes"}
    # The same as each kind alone.
    alone = hg.estimate(trips, hg.with_departure(requests.where("request_id in (1, 3)")), REPLY_FIELDS).collect()
    for r in alone:
        assert by_id[r.request_id]["count"] == r["count"] and by_id[r.request_id].fare_amount_total == r.fare_amount_total
    located = hg.geocode_requests(hg.with_departure(requests.where("request_id = 2")), responses)
    single = hg.estimate_address(trips, located, REPLY_FIELDS).first()
    for i in (2, 4):
        assert (by_id[i]["count"], by_id[i].level, by_id[i].total_amount_max) == (single["count"], single.level, single.total_amount_max)


def test_replies(spark, city, requests, responses):  # noqa: F811
    replies = {r.request_id: json.loads(r.reply) for r in trip_info_json(frame(spark, *city), requests, responses).collect()}
    stats = replies[1]["stats"]
    assert set(stats) == {"count", "duration", *REPLY_FIELDS}
    assert sum(stats["payment_type"].values()) <= stats["count"] and stats["fare_amount"]["max"] >= stats["fare_amount"]["avg"]
    assert replies[1]["startAddressInfo"]["formatted_address"] == "1 A St" and "destAddressInfo" not in replies[1]
    assert replies[2]["destAddressInfo"]["formatted_address"] == "2 B St"
    assert replies[1]["startGeom"].startswith("POLYGON ((-73.9841 40.7459, ")
    # A circle has as many corners as it has sides, and the first again.
    assert replies[2]["destGeom"].count(",") == 20 and replies[2]["startGeom"] == "POLYGON ((-73.99 40.74, -73.97 40.74, -73.97 40.76, -73.99 40.76, -73.99 40.74))"
    for i in (5, 6, 9):
        assert replies[i] == [["2016-05-04T10:00:00Z", 0]]
    assert replies[7] == [[None, 0]] and replies[8] == [[None, 0]]


def test_no_requests(spark, city, requests, responses):  # noqa: F811
    assert trip_info(frame(spark, *city), requests.limit(0), responses).count() == 0
    assert trip_info(frame(spark), requests, responses.limit(0)).where("matched").count() == 0


def counted(spark, rows):
    """The rows, and how many were read so far, over all plans."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(run, rows.schema), seen


def test_an_estimate_reads_the_trips_three_times(spark, city, asked):  # noqa: F811
    requests = spark.createDataFrame(asked, "request_id int, start_lon double, start_lat double, dest_lon double, dest_lat double, start_sec int")
    for limits in ({}, {"broadcast_cells": 0}):
        trips, seen = counted(spark, frame(spark, *city))
        answers = hg.estimate(trips, requests, ["fare_amount"], **limits)
        assert answers.count() == len(asked)
        assert seen.value <= 3 * len(city)


def test_the_pyramid_never_promises_too_much(spark, city, asked):  # noqa: F811
    requests = spark.createDataFrame(asked, "request_id int, start_lon double, start_lat double, dest_lon double, dest_lat double, start_sec int")
    trips = frame(spark, *city)
    keys = [*est.PLACES, "start_sec"]
    known = requests.dropna().select(*keys).distinct()
    planned = {tuple(r)[:5]: r for r in est._planned(known, est._pyramid(trips), keys).collect()}
    for r in hg.estimate(trips, requests.dropna()).where("matched").collect():
        own = planned[tuple(r[k] for k in keys)]
        # A level that is certain has trips, so the first one is no later.
        assert r.level <= own["_certain"]
        assert own["_try"] <= own["_certain"]


def test_stretches_make_up_any_seconds(spark):
    rows = spark.range(400).select((F.pmod(F.xxhash64("id"), F.lit(86400))).alias("s"))
    parts = rows.select("s", F.inline(est._rings(F.col("s")))).select("s", "level", "low", "high", est._stretches(F.col("low"), F.col("high")).alias("parts")).collect()
    by_level = {}
    for r in parts:
        seconds = []
        for p in r.parts:
            j, place = p >> 17, p & (1 << 17) - 1
            seconds += range(place << j, place + 1 << j)
        assert sorted(seconds) == list(range(r.low, r.high + 1))
        assert len(r.parts) <= 2 * 15
        by_level.setdefault((r.s, r.level), []).extend(seconds)
    for (s, level), seconds in by_level.items():
        reach, inner = 600 << level, 600 << (level - 1) if level else -1
        assert sorted(seconds) == [x for x in range(max(0, s - reach), min(86399, s + reach) + 1) if abs(x - s) > inner]


def test_answers_are_kept(spark, tmp_path, responses):
    path = str(tmp_path / "answers")
    asked_ = spark.createDataFrame([(1, "box", "circle"), (2, "circle", "missing"), (3, None, "box"), (3, None, "box")], "request_id int, start_address string, dest_address string")
    parsed, seen = counted(spark, responses)
    rows, counts = geocode_with_store(asked_.where("request_id = 1"), parsed, path, now=10)
    assert counts == {"asked": 2, "kept": 0, "parsed": 2} and rows.first().start_age == 0
    rows, counts = geocode_with_store(asked_, responses, path, now=17)
    assert counts == {"asked": 3, "kept": 2, "parsed": 0}
    by_id = {r.request_id: r for r in rows.collect()}
    assert rows.count() == 4 and by_id[2].dest_area is None and by_id[3].start_age is None
    assert by_id[1].start_age == 7 and by_id[1].dest_address_info.formatted_address == "2 B St"
    # Too old: asked again, and the newer answer counts.
    changed = spark.createDataFrame([("box", RESPONSES["circle"])], "key string, body string")
    rows, counts = geocode_with_store(asked_, changed, path, now=40, max_age=5)
    assert counts == {"asked": 3, "kept": 0, "parsed": 1}
    newest = {r.key: r.answered_at for r in kept_answers(spark, path, now=40).collect()}
    assert newest == {"box": 40, "circle": 10}
    assert {r.key for r in kept_answers(spark, path, now=12).collect()} == {"box", "circle"}
    plain = hg.geocode_requests(asked_, responses)
    rows, _ = geocode_with_store(asked_, responses, str(tmp_path / "other"), now=1)
    columns = ["request_id", "start_area", "dest_area", "start_address_info", "dest_address_info"]
    assert sorted(map(str, rows.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))
