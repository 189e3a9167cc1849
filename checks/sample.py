"""Trips, requests, geocoder responses and polygon layers derived from the given tables.

The tables hold no taxi data, so every row of ``lineitem`` is turned into one
trip, every order into one request and so on, by arithmetic on their keys. The
expressions are plain SQL that both engines read the same way; what differs
between them is passed in as a parameter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hailgrid.checkpoints import ensure_checkpoint_dir
from hailgrid.functions.geometry import place_key
from hailgrid.schema import STAGED_FIELDS

# Epoch seconds of a timestamp without zone that lies on midnight.
SPARK_EPOCH = "unix_date(cast({0} as date)) * 86400L"
DUCK_EPOCH = "cast(epoch({0}) as bigint)"

TRIPS = """
select k.*, day_s + tod as pickup_s,
  day_s + tod + 60 + mod(l_partkey * 37 + l_suppkey * 11 + l_linenumber, 3600) as dropoff_s,
  mod(day_s + tod, 86400) as time_of_day_sec,
  60 + mod(l_partkey * 37 + l_suppkey * 11 + l_linenumber, 3600) as duration_s,
  cast(1 + mod(l_suppkey, 2) as int) as vendor_id,
  cast(1 + mod(l_linenumber, 6) as int) as passenger_count,
  l_quantity / 10e0 as trip_distance,
  case when mod(l_orderkey + l_partkey, 97) = 0 then 0e0
       else -74.03e0 + mod(l_partkey * 53 + l_orderkey * 3, 1000) / 10000e0 end as pickup_longitude,
  case when mod(l_orderkey + l_partkey, 97) = 0 then 0e0
       else 40.70e0 + mod(l_suppkey * 71 + l_orderkey * 7, 1000) / 10000e0 end as pickup_latitude,
  -74.03e0 + mod(l_partkey * 29 + l_suppkey * 101 + l_linenumber * 211, 1000) / 10000e0 as dropoff_longitude,
  40.70e0 + mod(l_orderkey * 31 + l_partkey * 11 + l_linenumber * 17, 1000) / 10000e0 as dropoff_latitude,
  cast(1 + mod(l_partkey, 8) as int) as rate_code_id,
  cast(mod(l_orderkey, 8) as int) as payment_type,
  cast(mod(l_orderkey, 3) as int) as cab_type,
  l_returnflag = 'R' as store_and_fwd_flag,
  l_extendedprice / 1000e0 as fare_amount,
  l_discount * 10e0 as tip_amount,
  l_tax * 10e0 as tolls_amount,
  l_extendedprice / 1000e0 + l_discount * 10e0 + l_tax * 10e0 as total_amount,
  0e0 as extra, 0e0 as mta_tax, 0e0 as improvement_surcharge, 0 as trip_type, l_tax * 50e0 as ehail_fee
from (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
    {epoch} as day_s,
    case when mod(l_orderkey + l_linenumber * 3, 211) = 0 then 0
         else mod(l_orderkey * 7919 + l_linenumber * 3607 + l_partkey * 13, 86400) end as tod
  from lineitem
) k
"""

# One request per order. A third of them ask for the same trip; some lack a
# coordinate, some have no readable time, some start far from any trip.
REQUESTS = """
select o_orderkey as request_id,
  case when mod(o_orderkey, 101) = 0 then null when mod(o_orderkey, 107) = 0 then -73.0e0
       when mod(o_orderkey, 3) = 0 then -73.98e0
       else -74.03e0 + mod(o_orderkey * 17 + o_custkey * 5, 1000) / 10000e0 end as start_lon,
  case when mod(o_orderkey, 3) = 0 then 40.75e0
       else 40.70e0 + mod(o_orderkey * 23 + o_custkey * 7, 1000) / 10000e0 end as start_lat,
  case when mod(o_orderkey, 3) = 0 then -73.97e0
       else -74.03e0 + mod(o_orderkey * 41 + o_custkey * 11, 1000) / 10000e0 end as dest_lon,
  case when mod(o_orderkey, 3) = 0 then 40.76e0
       else 40.70e0 + mod(o_orderkey * 29 + o_custkey * 3, 1000) / 10000e0 end as dest_lat,
  case when mod(o_orderkey, 103) = 0 then null else tod end as tod,
  case when mod(o_orderkey, 103) = 0 then 'soon' else
    concat(cast(cast(o_orderdate as date) as string), 'T', lpad(cast(cast(floor(tod / 3600) as int) as string), 2, '0'), ':',
      lpad(cast(cast(floor(mod(tod, 3600) / 60) as int) as string), 2, '0'), ':',
      lpad(cast(mod(tod, 60) as string), 2, '0'), '.000Z') end as start_time,
  case when mod(o_orderkey, 3) = 0 then 'Customer#000000001' else c_name end as start_address,
  case when mod(o_orderkey, 113) = 0 then null else concat('NATION ', cast(c_nationkey as string)) end as dest_address
from (select o_orderkey, o_custkey, o_orderdate,
        case when mod(o_orderkey, 3) = 0 then 30600
             else mod(o_orderkey * 4871 + o_custkey * 13, 86400) end as tod from orders) o
join customer on c_custkey = o_custkey
"""

# Places of customers and nations, and what a geocoder says about them.
PLACES = """
select c_name as key, -74.03e0 + mod(c_custkey * 37, 1000) / 10000e0 as lon,
  40.70e0 + mod(c_custkey * 59, 1000) / 10000e0 as lat, 0.006e0 as half,
  case when mod(c_custkey, 13) = 4 then 'empty' when mod(c_custkey, 11) = 3 then 'none'
       when mod(c_custkey, 5) = 0 then 'bounds' else 'location' end as shape,
  case when mod(c_custkey, 7) = 2 then 'second' when mod(c_custkey, 7) = 5 then 'no' else 'first' end as street
from customer
union all
select concat('NATION ', cast(n_nationkey as string)), -74.00e0 + mod(n_nationkey * 37, 60) / 1000e0,
  40.73e0 + mod(n_nationkey * 59, 60) / 1000e0, 0.01e0, 'bounds', 'no'
from nation
"""

# One window per customer, with areas of seven and five sizes and times of four; a third of the
# starts are circles, some lie at the edge of the city or beyond it.
WINDOWS = """
select c_custkey, -74.03e0 + mod(c_custkey * 37, 1000) / 10000e0 as x, 40.70e0 + mod(c_custkey * 59, 1000) / 10000e0 as y,
  case mod(c_custkey, 7) when 0 then 0.001e0 when 1 then 0.003e0 when 2 then 0.0041e0 when 3 then 0.012e0 when 4 then 0.03e0
    when 5 then 0.06e0 else 0.9e0 end as half, mod(c_custkey, 3) = 0 as round,
  -74.03e0 + mod(c_custkey * 53, 1000) / 10000e0 as to_x, 40.70e0 + mod(c_custkey * 31, 1000) / 10000e0 as to_y,
  case mod(c_custkey, 5) when 0 then 0.004e0 when 1 then 0.008e0 when 2 then 0.02e0 when 3 then 0.05e0 else 0.5e0 end as to_half,
  mod(c_custkey * 4871, 86400) as middle,
  case mod(c_custkey, 4) when 0 then 900 when 1 then 3600 when 2 then 14400 else 86400 end as reach
from customer
"""

# CSV lines of five file layouts, with the cell spellings seen in such files.
HEADERS = (
    "vendor_name,Trip_Pickup_DateTime,Trip_Dropoff_DateTime,Passenger_Count,Trip_Distance,Start_Lon,Start_Lat,"
    "Rate_Code,store_and_forward,End_Lon,End_Lat,Payment_Type,Fare_Amt,surcharge,mta_tax,Tip_Amt,Tolls_Amt,Total_Amt",
    "vendor_id, pickup_datetime, dropoff_datetime, passenger_count, trip_distance, pickup_longitude, pickup_latitude,"
    " rate_code, store_and_fwd_flag, dropoff_longitude, dropoff_latitude, payment_type, fare_amount, surcharge,"
    " mta_tax, tip_amount, tolls_amount, total_amount",
    "VendorID,tpep_pickup_datetime,tpep_dropoff_datetime,passenger_count,trip_distance,pickup_longitude,"
    "pickup_latitude,RateCodeID,store_and_fwd_flag,dropoff_longitude,dropoff_latitude,payment_type,fare_amount,extra,"
    "mta_tax,tip_amount,tolls_amount,improvement_surcharge,total_amount",
    "VendorID,lpep_pickup_datetime,Lpep_dropoff_datetime,Store_and_fwd_flag,RateCodeID,Pickup_longitude,"
    "Pickup_latitude,Dropoff_longitude,Dropoff_latitude,Passenger_count,Trip_distance,Fare_amount,Extra,MTA_tax,"
    "Tip_amount,Tolls_amount,Ehail_fee,Total_amount,Payment_type,Trip_type ",
    "VendorID,tpep_pickup_datetime,tpep_dropoff_datetime,passenger_count,PULocationID,fare_amount",
)
FILES = (
    "yellow_tripdata_2009-01.csv",
    "Yellow_tripdata_2012-05.csv",
    "yellow_green_2015-02.csv",
    "green_tripdata_2013-08.csv",
    "other_2017-01.csv",
)
# Columns of the cell table below in the order of each layout.
LAYOUTS = (
    "vendor pickup dropoff passengers distance plon plat rate flag dlon dlat payment fare surcharge mta tip tolls total",
    "vendor pickup dropoff passengers distance plon plat rate flag dlon dlat payment fare surcharge mta tip tolls total",
    "vendor pickup dropoff passengers distance plon plat rate flag dlon dlat payment fare extra mta tip tolls surcharge total",
    "vendor pickup dropoff flag rate plon plat dlon dlat passengers distance fare extra mta tip tolls ehail total payment trip_type",
    "vendor pickup dropoff passengers rate fare",
)


def _pick(key: str, values: list[str], column: str) -> str:
    """Case expression that walks through ``values`` with a key."""
    quoted = ["'" + v.replace("'", "''") + "'" for v in values]
    cases = " ".join(f"when {i} then {q}" for i, q in enumerate(quoted))
    return f"case mod({key}, {len(values)}) {cases} end as {column}"


VENDORS = ["1", "2", "CMT", "vts", "DDS", "", "Cmt", "3"]
PAYMENTS = ["CRD", "Credit", "CAS", "Cash", "CSH", "No Charge", "NA", "NOC", "no", "Dispute", "UNK", "Voided trip",
            "7", "zzz", "", "1", "1.5", "cre_dit"]
FLAGS = ["Y", "y", "1", "N", "0", ""]
COUNTS = ["3", "+5", " 3 ", "1.5", "99999999999", "-2", "", "1"]
AMOUNTS = ["abc", "", " 2.5", "NaN", "inf", "1d", "-0.5"]

# Cells of one line per lineitem row. ``mode`` is how the two times are written:
# padded, single digits, month 13, text after it, blank, a five-digit year, seconds of
# eight digits, month -1, or padded by default.
CELLS = (
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(mod(l_orderkey, 5) as int) as layout, "
    + ", ".join(
        [
            _pick("l_partkey", VENDORS, "vendor"),
            _pick("l_suppkey", PAYMENTS, "payment"),
            _pick("l_partkey + l_suppkey", FLAGS, "flag"),
            _pick("l_orderkey + l_suppkey", COUNTS, "passengers"),
            _pick("l_linenumber", ["1", "6", "x"], "rate"),
            _pick("l_partkey + l_linenumber", [*AMOUNTS, "12.25"], "extra"),
        ]
    )
    + """,
  case mod(l_suppkey, 17) when 1 then 'single' when 2 then 'roll' when 3 then 'tail' when 4 then 'blank' when 5 then 'far'
    when 6 then 'long' when 7 then 'minus' else 'padded' end as mode,
  {epoch} as day_s, cast(l_shipdate as date) as day,
  mod(l_orderkey * 7919 + l_linenumber * 3607 + l_partkey * 13, 86400) as tod,
  case mod(l_partkey, 89) when 7 then '' when 8 then 'west' else
    cast(-74.03e0 + mod(l_partkey * 53 + l_orderkey * 3, 1000) / 10000e0 as string) end as plon,
  cast(40.70e0 + mod(l_suppkey * 71 + l_orderkey * 7, 1000) / 10000e0 as string) as plat,
  cast(-74.03e0 + mod(l_partkey * 29 + l_suppkey * 101 + l_linenumber * 211, 1000) / 10000e0 as string) as dlon,
  cast(40.70e0 + mod(l_orderkey * 31 + l_partkey * 11 + l_linenumber * 17, 1000) / 10000e0 as string) as dlat,
  cast(l_quantity / 10e0 as string) as distance, cast(l_extendedprice / 1000e0 as string) as fare,
  cast(l_discount * 10e0 as string) as tip, cast(l_tax * 10e0 as string) as tolls,
  cast(l_extendedprice / 1000e0 + 1e0 as string) as total, '0.5' as mta, '0.25' as surcharge, '0.75' as ehail,
  '2' as trip_type
from lineitem"""
)


def _clock(second: str) -> str:
    parts = [f"floor(({second}) / 3600)", f"floor(mod({second}, 3600) / 60)", f"mod({second}, 60)"]
    return ", ':', ".join(f"lpad(cast(cast({p} as int) as string), 2, '0')" for p in parts)


def _time_text(day: str, second: str) -> str:
    """Text of a date and second of day in the row's ``mode``."""
    year, month, dom = (f"cast(extract({p} from {day}) as string)" for p in ("year", "month", "day"))
    single = [f"floor(({second}) / 3600)", f"floor(mod({second}, 3600) / 60)", f"mod({second}, 60)"]
    loose = ", ':', ".join(f"cast(cast({p} as int) as string)" for p in single)
    padded = f"cast({day} as string), ' ', {_clock(second)}"
    return (
        f"case mode when 'single' then concat({year}, '-', {month}, '-', {dom}, ' ', {loose}) "
        f"when 'roll' then concat({year}, '-13-45 ', {_clock(second)}) "
        f"when 'tail' then concat({padded}, ' EST') when 'blank' then '' "
        f"when 'far' then concat('1', cast({day} as string), ' ', {_clock(second)}) "
        f"when 'long' then concat(cast({day} as string), ' 00:00:0', cast(1000000 + ({second}) as string)) "
        f"when 'minus' then concat({year}, '--1-', {dom}, ' ', {_clock(second)}) else concat({padded}) end"
    )


def spark_cells() -> str:
    """Cells with both time texts; the drop-off is 600 s later on the same day or cut at its end."""
    inner = CELLS.format(epoch=SPARK_EPOCH.format("l_shipdate"))
    late = "least(tod + 600, 86399)"
    return f"select *, {_time_text('day', 'tod')} as pickup, {_time_text('day', late)} as dropoff from ({inner})"


# A table of so many bytes, one split of Spark's file scan, has row groups for many tasks.
SPREAD_BYTES = 128 << 20


def _bytes(spark: SparkSession, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def read(spark: SparkSession, sf_dir: str, *names: str, spread: bool = False) -> None:
    """Registers tables under their own names for the SQL in this module.

    ``spread`` is for work that is heavy per row: the table is dealt out to all
    cores, as the given files have one row group each. Larger tables are read by
    many tasks as they are, and aren't shuffled for that each time they are read.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name in names:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if spread and _bytes(spark, f"{sf_dir}/{name}.parquet") < SPREAD_BYTES:
            table = table.repartition(spark.sparkContext.defaultParallelism)
        table.createOrReplaceTempView(name)


# Columns of a trip that are computed from its keys and used many times.
ONCE = ("time_of_day_sec", "pickup_longitude", "pickup_latitude", "dropoff_longitude", "dropoff_latitude")


def trips(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Staged trips, one per lineitem row, with the row's keys."""
    read(spark, sf_dir, "lineitem", spread=spread)
    rows = spark.sql(TRIPS.format(epoch=SPARK_EPOCH.format("l_shipdate")))
    rows = rows.withColumn("pickup_datetime", F.timestamp_seconds("pickup_s")).withColumn(
        "dropoff_datetime", F.timestamp_seconds("dropoff_s")
    )
    # As generated columns, what filters and cells use is computed once, not anew at each use; the
    # method that reads the trips would else be too long for the JVM's compiler.
    rows = rows.select(*[c for c in rows.columns if c not in ONCE], F.inline(F.array(F.struct(*ONCE))))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[f.name for f in STAGED_FIELDS])


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "orders", "customer")
    return spark.sql(REQUESTS).drop("tod")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geocoder replies as JSON text, one per customer and nation."""
    read(spark, sf_dir, "customer", "nation")
    return spark.sql(
        f"""
        with p as ({PLACES}), j as (
          select *, case shape
            when 'bounds' then concat('"bounds":{{"northeast":{{"lat":', lat + half, ',"lng":', lon + half,
              '}},"southwest":{{"lat":', lat - half, ',"lng":', lon - half, '}}}},"location":{{"lat":', lat, ',"lng":', lon, '}}')
            when 'location' then concat('"location":{{"lat":', lat, ',"lng":', lon, '}}')
            else '' end as geometry,
            concat('"formatted_address":"', key, ' Street","address_components":[{{"long_name":"', key,
              '","short_name":"S","types":["route"]}}]') as address
          from p)
        select key, case when shape = 'empty' then '{{"results":[],"status":"ZERO_RESULTS"}}' else
          concat('{{"results":[{{"types":[', case when street = 'first' then '"premise","street_address"' else '"locality"' end,
            '],', address, ',"geometry":{{', geometry, '}}}}',
            case when street = 'second' then concat(',{{"types":["street_address"],"formatted_address":"Second ', key,
              '","address_components":[],"geometry":{{}}}}') else '' end,
            '],"status":"OK"}}') end as body
        from j"""
    )


def reverse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geocoder replies for the starts of requests, keyed ``lon,lat``."""
    places = requests(spark, sf_dir).where("start_lon is not null").select("start_lon", "start_lat").distinct()
    body = F.concat(
        F.lit('{"results":[{"types":["street_address"],"formatted_address":"Place '),
        F.col("start_lat").cast("string"),
        F.lit('","address_components":[],"geometry":{}}]}'),
    )
    return places.select(place_key(F.col("start_lon"), F.col("start_lat")).alias("key"), body.alias("body"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines with the header and name of their file, one per lineitem row."""
    read(spark, sf_dir, "lineitem", spread=True)
    cells = spark.sql(spark_cells())
    layout = F.col("layout")

    def by_layout(options):
        out = F.when(F.lit(False), F.lit(""))
        for i, option in enumerate(options):
            out = out.when(layout == i, option)
        return out

    # Every 83rd part has a line cut after twelve cells, every 79th an empty line.
    line = by_layout([F.concat_ws(",", *order.split()) for order in LAYOUTS])
    line = F.when(F.col("l_partkey") % 83 == 5, F.substring_index(line, ",", 12)).otherwise(line)
    line = F.when(F.col("l_partkey") % 79 == 6, F.lit("")).otherwise(line)
    return cells.select(
        "l_orderkey",
        by_layout([F.lit(f) for f in FILES]).alias("file_name"),
        by_layout([F.lit(h) for h in HEADERS]).alias("header"),
        line.alias("line"),
    )


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the session's checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def csv_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the sample lines as CSV files of several headers and names, and with files of another kind."""
    folder = new_folder(spark, "csv")
    every = lines(spark, sf_dir)
    plain = {"sep": "\u0001", "quote": "", "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    system = None
    for file_name, header in zip(FILES, HEADERS, strict=True):
        rows = every.where(F.col("file_name") == file_name).select(F.col("line").alias(header))
        place = f"{folder}/{file_name.removesuffix('.csv')}"
        rows.write.options(**plain).option("header", True).csv(place)
        # The cab is read off the file's name.
        jvm = spark._jvm.org.apache.hadoop.fs
        system = system or jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for i, status in enumerate(system.listStatus(jvm.Path(place))):
            if status.getPath().getName().endswith(".csv"):
                system.rename(status.getPath(), jvm.Path(f"{place}/{file_name.removesuffix('.csv')}-{i}.csv"))
    every.select("line").write.text(f"{folder}/notes")
    return folder


def polygon_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON feature collections, one per customer, with a square (or two) in a borough."""
    read(spark, sf_dir, "customer")
    return spark.sql(
        """
        with p as (select c_custkey, c_name,
            element_at(array('Manhattan', 'Bronx', 'Brooklyn', 'Queens', 'Staten Island'), cast(mod(c_custkey, 5) + 1 as int)) as borough,
            -74.03e0 + mod(c_custkey * 37, 1000) / 10000e0 as x, 40.70e0 + mod(c_custkey * 59, 1000) / 10000e0 as y from customer),
        s as (select *,
            concat('[[[', x, ',', y, '],[', x + 0.01e0, ',', y, '],[', x + 0.01e0, ',', y + 0.01e0, '],[', x, ',', y + 0.01e0, '],[', x, ',', y, ']]]') as one,
            concat('[[[', x + 0.5e0, ',', y, '],[', x + 0.51e0, ',', y, '],[', x + 0.51e0, ',', y + 0.01e0, '],[', x + 0.5e0, ',', y, ']]]') as two
          from p)
        select c_custkey, concat('{"type":"FeatureCollection","features":[',
          '{"type":"Feature","properties":{"borough":"', borough, '","name":"', c_name, '"},"geometry":{"type":"Polygon","coordinates":', one, '}}',
          case when mod(c_custkey, 3) = 0 then concat(',{"type":"Feature","properties":{"borough":"', borough,
            '"},"geometry":{"type":"MultiPolygon","coordinates":[', one, ',', two, ']}}') else '' end, ']}') as body
        from s"""
    )


# Corners of the zones around their middle, in degrees: an L with a hole, and a triangle beside it.
ZONE_SHELL = ((-0.012, -0.010), (0.014, -0.010), (0.014, 0.002), (0.003, 0.002), (0.003, 0.015), (-0.012, 0.015))
ZONE_HOLE = ((-0.008, -0.006), (-0.001, -0.006), (-0.001, 0.001), (-0.008, 0.001))
ZONE_SIDE = ((0.006, 0.004), (0.016, 0.006), (0.008, 0.013))
ZONES = """
select s_suppkey, case mod(s_suppkey, 5) when 0 then 'Manhattan' when 1 then 'Bronx' when 2 then 'Brooklyn' when 3 then 'Queens' else 'Staten Island' end as borough,
  -74.02e0 + mod(s_suppkey * 37, 800) / 10000e0 as x, 40.71e0 + mod(s_suppkey * 59, 800) / 10000e0 as y, mod(s_suppkey, 3) as shape from supplier
"""


def zone_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON of a zone for each supplier: a polygon, one with a hole, or that and another part."""
    read(spark, sf_dir, "supplier")

    def ring(corners) -> str:
        points = [f"'[', x + {dx!r}e0, ',', y + {dy!r}e0, ']'" for dx, dy in (*corners, corners[0])]
        return "concat('[', " + ", ',', ".join(points) + ", ']')"

    return spark.sql(
        f"""with z as ({ZONES}), r as (select *, {ring(ZONE_SHELL)} as shell, {ring(ZONE_HOLE)} as hole, {ring(ZONE_SIDE)} as side from z)
        select s_suppkey, concat('{{"type":"FeatureCollection","features":[{{"type":"Feature","properties":{{"borough":"', borough, '","name":"Zone ', s_suppkey,
          '"}},"geometry":', case shape when 0 then concat('{{"type":"Polygon","coordinates":[', shell, ']}}')
            when 1 then concat('{{"type":"Polygon","coordinates":[', shell, ',', hole, ']}}')
            else concat('{{"type":"MultiPolygon","coordinates":[[', shell, ',', hole, '],[', side, ']]}}') end, '}}]}}') as body from r"""
    )


# How each request of the mixed table asks, by its number: by coordinates, by addresses, by both, or by too little.
MIXED = """
select request_id, start_time, tod, start_address as a, dest_address as b,
  case when mod(request_id, 4) in (0, 2) then start_lon end as start_lon, case when mod(request_id, 4) <> 1 then start_lat end as start_lat,
  case when mod(request_id, 4) in (0, 2) then dest_lon end as dest_lon, case when mod(request_id, 4) in (0, 2) then dest_lat end as dest_lat,
  case when mod(request_id, 4) in (1, 2) then start_address when mod(request_id, 4) = 3 then '' end as start_address,
  case when mod(request_id, 4) in (1, 2, 3) then dest_address end as dest_address
from ({requests}) r
"""


def mixed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "orders", "customer")
    return spark.sql(MIXED.format(requests=REQUESTS)).drop("a", "b", "tod")
