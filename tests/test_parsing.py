import calendar
import math

import pytest
from pyspark.sql import functions as F

from hailgrid.functions import parsing
from hailgrid.operators.estimate import departure_seconds, departure_text
from hailgrid.sources.headers import field_of, field_positions


def apply(spark, parse, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in frame.select("i", parse(F.col("t")).alias("v")).orderBy("i").collect()]


def epoch(*parts):
    return calendar.timegm((*parts, 0, 0, 0))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_lenient_times_do_not_depend_on_the_session_zone(spark, zone):
    cases = {
        "2013-08-01 00:15:10": epoch(2013, 8, 1, 0, 15, 10),
        "2013-8-1 1:2:3": epoch(2013, 8, 1, 1, 2, 3),
        "2013-13-45 01:02:03": epoch(2014, 2, 14, 1, 2, 3),
        "2013-08-01 00:15:10 and more": epoch(2013, 8, 1, 0, 15, 10),
        "2013-08-01 00:15:10.7": epoch(2013, 8, 1, 0, 15, 10),
        " 2013-08-01  00:15:10": epoch(2013, 8, 1, 0, 15, 10),
        "2013-02-29 24:61:00": epoch(2013, 3, 2, 1, 1, 0),
        "2013-03-10 02:30:00": epoch(2013, 3, 10, 2, 30, 0),
        "2013-08-01T00:15:10": None,
        "2013-08-01": None,
        "tpep_pickup_datetime": None,
        "": None,
    }
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert apply(spark, parsing.lenient_epoch_seconds, list(cases)) == list(cases.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_numbers(spark):
    ints = {"3": 3, "+5": 5, "-2": -2, " 3 ": None, "1.5": None, "99999999999": None, "": None, "x": None}
    assert apply(spark, parsing.parse_int, list(ints)) == list(ints.values())
    doubles = {" 2.5": 2.5, "1d": 1.0, "-1e3": -1000.0, "1e999": math.inf, "Infinity": math.inf, "abc": None, "": None,
               "inf": None, "nan": None}
    assert apply(spark, parsing.parse_double, list(doubles)) == list(doubles.values())
    assert math.isnan(apply(spark, parsing.parse_double, ["NaN"])[0])


def test_codes(spark):
    vendors = {"1": 1, "2": 2, "CMT": 1, "vts": 2, "DDS": 0, "": 0, "3": 0}
    assert apply(spark, parsing.vendor_code, list(vendors)) == list(vendors.values())
    payments = {"CRD": 1, "Credit": 1, "cre_dit": 1, "CAS": 2, "Cash": 2, "CSH": 2, "No Charge": 3, "NA": 3, "NOC": 3, "no": 3,
                "Dispute": 4, "UNK": 5, "Voided trip": 6, "7": 7, "zzz": 0, "": 0, "not": 0,
                # Numbers that are no plain integers write nothing.
                "1.5": None, " 7 ": None, "0x1f": None}
    assert apply(spark, parsing.payment_code, list(payments)) == list(payments.values())
    assert apply(spark, parsing.flag, ["Y", "y", "1", "N", "0", "", None]) == [True, True, True, False, False, False, None]
    cabs = {"yellow_2013.csv": 1, "Green_2013.csv": 2, "yellow_green.csv": 1, "fhv.csv": 0}
    assert apply(spark, parsing.cab_code, list(cabs)) == list(cabs.values())


def test_departures(spark):
    texts = ["2016-05-04T08:30:15.123Z", "2016-05-04T08:30:15", "2016-05-04", "", None, "2016-05-04 08:30:15"]
    assert apply(spark, lambda t: departure_text(departure_seconds(t)), texts) == ["2016-05-04T08:30:15Z"] * 2 + [None] * 4


def test_header_matching():
    assert field_of(" Pickup_longitude") == "pickup_longitude"
    assert field_of("Trip_type ") == "trip_type"
    assert field_of("store_and_forward") == "store_and_fwd_flag"
    assert field_of("congestion_surcharge") == "improvement_surcharge"
    assert field_of("PULocationID") is None
    assert field_positions("VendorID,surcharge,improvement_surcharge,,")["improvement_surcharge"] == [1, 2]


def test_a_time_reads_its_text_once(spark):
    frame = spark.range(1).select(F.col("id").cast("string").alias("t")).repartition(1).select(parsing.lenient_epoch_seconds(F.col("t")).alias("v"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1
