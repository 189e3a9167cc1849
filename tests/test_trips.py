import json
import math
import random
import re
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

import hailgrid as hg
from hailgrid.functions import statistics
from hailgrid.operators.features import ID_COLUMNS
from hailgrid.schema import STAGED_SCHEMA


def trip(**values):
    row = {f.name: 0.0 if f.dataType.typeName() == "double" else 0 for f in STAGED_SCHEMA}
    row |= {"store_and_fwd_flag": False, "pickup_longitude": -73.98, "pickup_latitude": 40.75}
    row |= {"dropoff_longitude": -73.97, "dropoff_latitude": 40.76, "time_of_day_sec": 36000}
    row |= {"pickup_datetime": datetime(2013, 8, 1, 10, tzinfo=UTC), "dropoff_datetime": datetime(2013, 8, 1, 10, 10, tzinfo=UTC)}
    return tuple((row | values)[name] for name in STAGED_SCHEMA.fieldNames())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), STAGED_SCHEMA)


def test_statistics(spark):
    late = datetime(2013, 8, 1, 9, 59, tzinfo=UTC)
    trips = frame(
        spark,
        trip(fare_amount=1.5, payment_type=2, rate_code_id=9),
        trip(fare_amount=math.nan, payment_type=6, rate_code_id=1, dropoff_datetime=late),
        trip(fare_amount=4.0, payment_type=7, rate_code_id=6),
    )
    row = hg.trip_stats(trips).first()
    assert row["count"] == 3
    # NaN counts for the total only; bins outside the range are ignored.
    assert (row.fare_amount_min, row.fare_amount_max) == (1.5, 4.0) and math.isnan(row.fare_amount_total)
    assert [row[f"payment_type_{b}"] for b in range(7)] == [0, 0, 1, 0, 0, 0, 1]
    assert [row[f"rate_code_id_{b}"] for b in range(1, 7)] == [1, 0, 0, 0, 0, 1]
    assert (row.duration_min, row.duration_max, row.duration_total, row.duration_avg) == (-60, 600, 1140, 380)


def test_statistics_without_trips(spark):
    row = hg.trip_stats(frame(spark), ["fare_amount", "cab_type"]).first()
    assert row.asDict() == {
        "count": 0, "fare_amount_min": None, "fare_amount_max": None, "fare_amount_total": None, "fare_amount_avg": None,
        "cab_type_0": 0, "cab_type_1": 0, "cab_type_2": 0,
        "duration_min": None, "duration_max": None, "duration_total": None, "duration_avg": None,
    }


def test_selection_and_json(spark):
    assert statistics.stat_fields(["extra", "cab_type", "fare_amount"]) == ["fare_amount", "cab_type"]
    assert statistics.stat_fields([]) == []
    with pytest.raises(ValueError, match="unknown fields"):
        statistics.stat_fields(["fares"])
    stats = hg.trip_stats(frame(spark, trip(fare_amount=2.5, cab_type=1)), ["fare_amount", "cab_type"])
    text = hg.stats_json(stats, ["fare_amount", "cab_type"]).first().stats
    assert json.loads(text) == {
        "count": 1,
        "fare_amount": {"min": 2.5, "max": 2.5, "total": 2.5, "avg": 2.5},
        "cab_type": {"0": 0, "1": 1, "2": 0},
        "duration": {"min": 600, "max": 600, "total": 600, "avg": 600},
    }


def test_merged_parts_equal_the_whole(spark):
    rng = random.Random(1)
    trips = frame(spark, *[trip(fare_amount=rng.randrange(100) / 4, payment_type=rng.randrange(8)) for _ in range(200)])
    fields = statistics.stat_fields()
    parts = trips.groupBy("payment_type").agg(*statistics.partial(fields))
    merged = parts.agg(*statistics.merge(fields)).select(*statistics.finish(fields)).first()
    whole = hg.trip_stats(trips).first()
    assert merged == whole
    assert sum(whole[f"payment_type_{b}"] for b in range(7)) <= whole["count"]


def test_validity_and_windows(spark):
    trips = frame(spark, trip(), trip(time_of_day_sec=0), trip(pickup_longitude=0.0), trip(dropoff_latitude=-0.0), trip(time_of_day_sec=86399))
    assert hg.valid_trips(trips).count() == 2
    assert trips.where(hg.in_time_of_day(36000, 36000)).count() == 3
    # No wrap at midnight.
    assert trips.where(hg.in_time_of_day(-300, 900)).count() == 1
    period = hg.in_period(datetime(2013, 8, 1, 10, tzinfo=UTC), datetime(2013, 8, 1, 10, tzinfo=UTC), hg.box_around(-73.98, 40.75))
    assert trips.where(period).count() == 4


def test_layers(spark):
    trips = frame(spark, trip(ehail_fee=2.9))
    pickup, dropoff = hg.features(trips).first(), hg.features(trips, "dropoff").first()
    assert pickup.trip_id == "1375351200000_1375351800000_POINT (-73.98 40.75)_POINT (-73.97 40.76)_" == dropoff.trip_id
    assert len(pickup) == 26 and pickup.ehail_fee == 2
    assert tuple(pickup[8]) == (-73.98, 40.75) and tuple(dropoff[8]) == (-73.97, 40.76)
    assert tuple(dropoff.pickup_location) == (-73.98, 40.75) and dropoff.time_of_day_sec == 36000
    with pytest.raises(ValueError, match="role"):
        hg.features(trips, "middle")


def test_latest_trip_of_a_hot_id(spark):
    copies = frame(spark, trip()).select("*", F.explode(F.sequence(F.lit(1), F.lit(5000))).alias("ingest_seq"))
    copies = copies.withColumn("fare_amount", F.col("ingest_seq") / 2.0)
    other = frame(spark, trip(pickup_longitude=-73.5)).withColumn("ingest_seq", F.lit(1))
    latest = hg.latest_trips(copies.unionByName(other))
    assert sorted((r.ingest_seq, r.fare_amount) for r in latest.collect()) == [(1, 0.0), (5000, 2500.0)]
    assert latest.columns == copies.columns and set(ID_COLUMNS) <= set(latest.columns)
    # Copies are combined before the shuffle.
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("partial_max")


def test_heat_map_keeps_weight_inside(spark):
    trips = frame(spark, trip(), trip(), trip(pickup_longitude=-75.0), trip(pickup_longitude=-74.375, pickup_latitude=40.3))
    rows = {(r.x, r.y): r.density for r in hg.heatmap(trips, cells=64).collect()}
    assert max(rows.values()) == 2 * 36 / 256
    # Two whole kernels and the quarter of one in the corner.
    assert sum(rows.values()) == 2 + (11 / 16) ** 2
    assert hg.point_layer(trips, hg.box(-74, 40, -73, 41)).count() == 2


def test_period_is_utc_whatever_the_zone_of_the_driver(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    script = """
from datetime import datetime, timedelta, timezone
from pyspark.sql import SparkSession, functions as F
import hailgrid as hg
spark = SparkSession.builder.master("local[1]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
row = spark.range(1).select(F.timestamp_seconds(F.lit(6 * 3600)).alias("pickup_datetime"), F.lit(0.0).alias("pickup_longitude"), F.lit(0.0).alias("pickup_latitude"))
inside = hg.in_period(datetime(1970, 1, 1, 5), datetime(1970, 1, 1, 7), hg.box(-1, -1, 1, 1))
eastern = timezone(timedelta(hours=-5))
aware = hg.in_period(datetime(1970, 1, 1, 0, tzinfo=eastern), datetime(1970, 1, 1, 2, tzinfo=eastern), hg.box(-1, -1, 1, 1))
print("FOUND", row.where(inside).count(), row.where(aware).count())
"""
    root = str(Path(__file__).resolve().parent.parent)
    env = os.environ | {"TZ": "America/New_York", "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", script], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "FOUND 1 1" in done.stdout


@pytest.mark.parametrize("name", ["circle_filter", "trip_query", "trip_query_circles", "feature_scan", "multi_area_filter", "stored_trip_query"])
def test_generated_code_is_compiled(spark, name):
    """Methods of more than 8,000 bytes aren't compiled to machine code."""
    from checks.queries import QUERIES

    frame = QUERIES[name](spark, "/root/testdata/sf0.001")
    frame.collect()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", frame._jdf.queryExecution().explainString(mode))]
    assert sizes and max(sizes) < 8000
