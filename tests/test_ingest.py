import pytest
from pyspark.sql import functions as F

import hailgrid as hg
from hailgrid.operators.filters import area_blocks
from hailgrid.schema import STAGED_FIELDS, STAGED_SCHEMA

OLD = "vendor_name,Trip_Pickup_DateTime,Trip_Dropoff_DateTime,Start_Lon,Start_Lat,End_Lon,End_Lat,Payment_Type,Fare_Amt,surcharge"
NEW = "VendorID,lpep_pickup_datetime,Lpep_dropoff_datetime,Pickup_longitude,Pickup_latitude,Dropoff_longitude,Dropoff_latitude,Fare_amount,Payment_type,Trip_type "


def write(path, header, *lines, end="\n"):
    path.write_text(end.join([header, *lines]) + end)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "csv" / "2009").mkdir(parents=True)
    write(
        tmp_path / "csv" / "2009" / "yellow_2009.csv", OLD,
        "VTS,2009-01-01 10:00:00,2009-01-01 10:10:00,-73.98,40.75,-73.97,40.76,Cash,9.5,0.5",
        "",
        "CMT,2009-01-01 10:00:00,2009-01-01 10:10:00,-73.98,40.75,-73.97",  # no required latitude
        "CMT,2009-01-02 00:00:00,2009-01-02 00:10:00,-73.98,40.75,-73.97,40.76",  # midnight, short but complete
        "CMT,2009-01-03 11:00:00,2009-01-03 10:50:00,NaN,40.75,-73.97,40.76,,,",
    )
    write(
        tmp_path / "csv" / "green_2013.csv", NEW,
        "2,2013-8-1 7:00:00,2013-8-1 7:20:00,-73.95,40.80,-73.99,40.73,12.5,2,1",
        "1,2013-08-01 07:00:00,2013-08-01 07:20:00,0,40.80,-73.99,40.73,12.5,2,",
        end="\r\n",
    )
    write(tmp_path / "csv" / "notes.txt", NEW, "2,2013-8-1 7:00:00,2013-8-1 7:20:00,-73.95,40.80,-73.99,40.73,12.5,2,1")
    return tmp_path


def test_read_trips_groups_files_by_header(spark, folder):
    trips = hg.read_trips(spark, str(folder / "csv"))
    assert trips.schema.simpleString() == STAGED_SCHEMA.simpleString()
    rows = sorted(trips.collect(), key=lambda r: (r.cab_type, r.pickup_datetime, r.vendor_id))
    assert [(r.cab_type, r.vendor_id, r.payment_type, r.fare_amount, r.time_of_day_sec) for r in rows] == [
        (1, 2, 2, 9.5, 36000),
        (1, 1, 0, 0.0, 0),
        (1, 1, 0, 0.0, 39600),
        (2, 1, 2, 12.5, 25200),
        (2, 2, 2, 12.5, 25200),
    ]
    assert [r.trip_type for r in rows] == [0, 0, 0, 0, 1]
    assert rows[0].improvement_surcharge == 0.5
    assert all(value is not None for r in rows for value in r)


def test_no_files(spark, tmp_path):
    assert hg.read_trips(spark, str(tmp_path)).count() == 0


def test_last_column_of_a_field_that_parses_wins(spark):
    header = OLD + ",improvement_surcharge,vendor_id,payment_type"
    base = "VTS,2009-01-01 10:00:00,2009-01-01 10:10:00,-73.98,40.75,-73.97,40.76,Cash,9.5,0.5"
    lines = spark.createDataFrame(
        [(base + rest, header, "f.csv") for rest in (",0.7,CMT,Credit", ",x,DDS,1.5", ",,,", ",0.9,,zzz")],
        "line string, header string, file_name string",
    )
    got = hg.parse_lines(lines, [header]).select("improvement_surcharge", "vendor_id", "payment_type").collect()
    # Trailing empty cells are absent; an unknown word or vendor writes 0.
    assert sorted(map(tuple, got)) == [(0.5, 0, 2), (0.5, 2, 2), (0.7, 1, 1), (0.9, 0, 0)]


def test_header_without_required_fields_gives_no_rows(spark):
    lines = spark.createDataFrame([("1,2", "a,b", "f.csv")], "line string, header string, file_name string")
    assert hg.parse_lines(lines, ["a,b"]).count() == 0


def test_layer_round_trip(spark, folder):
    staged, layer = str(folder / "staged"), str(folder / "layer")
    hg.stage(spark, str(folder / "csv"), staged, ingest_seq=0)
    hg.stage(spark, str(folder / "csv" / "green_2013.csv"), staged, ingest_seq=1)
    assert hg.read_staged(spark, staged).count() == 7
    for role in ("pickup", "dropoff"):
        hg.build_layer(spark, staged, f"{layer}-{role}", role)
        stored = spark.read.parquet(f"{layer}-{role}")
        # Zero coordinates and midnight are left out; the second load replaces the first.
        assert stored.count() == 3
        assert stored.columns[8] == ("pickup_location" if role == "pickup" else "dropoff_location")
        near = hg.scan_layer(spark, f"{layer}-{role}", role, 25000, 26000, hg.box_around(-73.95, 40.8), hg.circle(-73.99, 40.73))
        assert [(r.trip_id, r.fare_amount) for r in near.collect()] == [
            ("1375340400000_1375341600000_POINT (-73.95 40.8)_POINT (-73.99 40.73)_", 12.5)
        ]


def test_estimate_reads_the_blocks_it_needs(spark, folder):
    staged, layer = str(folder / "staged"), str(folder / "layer")
    hg.stage(spark, str(folder / "csv"), staged, ingest_seq=0)
    for role in ("pickup", "dropoff"):
        hg.build_layer(spark, staged, layer + role, role)
        trips = spark.read.parquet(layer + role)
        windows = spark.createDataFrame([(1, -73.95, 40.80, -73.99, 40.73)], "id int, a double, b double, c double, d double")
        window = hg.Window(hg.search_box(F.col("a"), F.col("b")), hg.search_box(F.col("c"), F.col("d")))
        stats = hg.window_stats(windows, window, trips, ["id"], [])
        assert [(r.id, r["count"]) for r in stats.collect()] == [(1, 1)]
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = stats._jdf.queryExecution().explainString(mode)
        assert f"{role}_block" in plan.split("PartitionFilters: ")[1].split("\n")[0]
        assert "GreaterThanOrEqual(dropoff_latitude" in plan


def test_area_blocks_agree_with_the_column(spark):
    from hailgrid.functions.grid import block

    points = [(-74.5, 40.0), (-74.0, 40.7), (-73.98, 40.75), (-73.575, 41.1), (-73.0, 42.0)]
    frame = spark.createDataFrame(points, "x double, y double").select("x", "y", block(F.col("x"), F.col("y")).alias("b"))
    for row in frame.collect():
        assert area_blocks(hg.box(row.x, row.y, row.x, row.y)) == [row.b]


def test_scan_reads_only_what_it_needs(spark, folder):
    staged, layer = str(folder / "staged"), str(folder / "layer")
    hg.stage(spark, str(folder / "csv"), staged, ingest_seq=0)
    hg.build_layer(spark, staged, layer)
    rows = hg.scan_layer(spark, layer, start_sec=1, end_sec=500, pickup=hg.box_around(-73.95, 40.8))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = hg.trip_stats(rows, ["fare_amount"])._jdf.queryExecution().explainString(mode)
    pushed = plan.split("PushedFilters: ")[1].split("\n")[0]
    assert "GreaterThanOrEqual(pickup_longitude" in pushed and "GreaterThanOrEqual(time_of_day_sec" in pushed
    assert "pickup_block" in plan.split("PartitionFilters: ")[1].split("\n")[0]
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "fare_amount" in schema and "tip_amount" not in schema


def test_staged_schema_is_the_fixed_one():
    assert len(STAGED_FIELDS) == 23


def test_many_headers_and_files_take_a_fixed_number_of_jobs(spark, tmp_path):
    line = "2,2013-8-1 7:00:00,2013-8-1 7:20:00,-73.95,40.80,-73.99,40.73,12.5,2,1"

    def jobs(count, folder):
        folder.mkdir()
        for i in range(count):
            write(folder / f"green_{i}.csv", f"{NEW},other_{i}", line, "no trip here")
        spark.sparkContext.setJobGroup(str(folder), "")
        assert hg.read_trips(spark, str(folder)).count() == count
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(folder)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    assert jobs(250, tmp_path / "many") <= jobs(2, tmp_path / "few") + 4


def test_only_a_first_line_is_a_header(spark, tmp_path):
    (tmp_path / "yellow.csv").write_text(f"a comment\n{NEW}\n2,2013-8-1 7:00:00,2013-8-1 7:20:00,-73.95,40.80,-73.99,40.73,12.5,2,1\n")
    assert hg.read_trips(spark, str(tmp_path)).count() == 0


def test_large_tables_are_not_dealt_out_again(spark, tmp_path, monkeypatch):
    from checks import sample

    spark.range(100).write.parquet(f"{tmp_path}/lineitem.parquet")
    shuffled = []
    for most in (1 << 30, 10):
        monkeypatch.setattr(sample, "SPREAD_BYTES", most, raising=False)
        sample.read(spark, str(tmp_path), "lineitem", spread=True)
        table = spark.table("lineitem")
        shuffled.append("Repartition" in table._jdf.queryExecution().optimizedPlan().toString())
        assert table.count() == 100
    assert shuffled == [True, False]
