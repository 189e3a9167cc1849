"""The registered queries: one per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import hailgrid as hg
from checks import sample
from hailgrid.functions import geometry, grid, parsing, pluggable, statistics
from hailgrid.operators import address_cache
from hailgrid.operators import estimate as est
from hailgrid.operators.features import trip_id
from hailgrid.operators.filters import DROPOFF, PICKUP
from hailgrid.operators.trip_info import REPLY_FIELDS
from hailgrid.schema import BY_NAME, DEFAULT_STAT_FIELDS, STAGED_FIELDS, Histogram, Summary

# Areas the registered queries look at.
CIRCLE = (-73.98, 40.75, 0.02)
BOX_A = (-74.0, 40.72, -73.96, 40.78)
BOX_B = (-73.99, 40.71, -73.95, 40.77)
START_CIRCLE = (-73.954818725585937, 40.820701599121094, 0.005)
DEST_CIRCLE = (-73.998832702636719, 40.729896545410156, 0.005)
WINDOW = (21600, 64800)
PERIOD = (datetime(1996, 3, 1, 6), datetime(1998, 9, 15, 18))
# An L with a hole, and a triangle far from a plain box.
SHELL = [(-74.02, 40.705), (-73.94, 40.705), (-73.94, 40.735), (-73.985, 40.735), (-73.985, 40.79), (-74.02, 40.79)]
HOLE = [(-74.01, 40.715), (-73.995, 40.715), (-73.995, 40.73), (-74.01, 40.73)]
TRIANGLE = [(-73.97, 40.75), (-73.935, 40.76), (-73.95, 40.795)]
PART_A, PART_B = (-74.02, 40.71, -74.0, 40.74), (-73.96, 40.76, -73.935, 40.79)

IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SUMMARY_FIELDS = [n for n in DEFAULT_STAT_FIELDS if isinstance(BY_NAME[n].stat, Summary)]
HISTOGRAM_FIELDS = [n for n in DEFAULT_STAT_FIELDS if isinstance(BY_NAME[n].stat, Histogram)]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(build: Query) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Before the plan is built: timestamps are read in the session's zone.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(spark, sf_dir)

    QUERIES[build.__name__.removesuffix("_")] = query
    return query


def _valid(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    return hg.valid_trips(sample.trips(spark, sf_dir, spread))


# Sums of doubles depend on their order in the last digits, so statistics are
# rounded: totals over all trips to 6 places, those of a request, which are
# smaller and have more places of their own, to 10.
WHOLE_PLACES, REQUEST_PLACES = 6, 10
# Averages of 64 values may lie just between two rounded ones; this moves them off.
TIE_SHIFT = 1.3e-12


def _rounded(stats: DataFrame, places: int = WHOLE_PLACES) -> DataFrame:
    parts = ("_min", "_max", "_total", "_avg")
    return stats.select(*[F.round(c, places).alias(c) if c.endswith(parts) else F.col(c) for c in stats.columns])


def _counted(trips: DataFrame) -> DataFrame:
    return _rounded(hg.trip_stats(trips, ["fare_amount"]))


# Statistics


@register
def trip_query(spark, sf_dir):
    pickup, dropoff = hg.circle(*CIRCLE), hg.box(*BOX_B)
    return _rounded(hg.trip_query(_valid(spark, sf_dir), *WINDOW, pickup, dropoff))


@register
def trip_query_circles(spark, sf_dir):
    pickup, dropoff = hg.circle(*START_CIRCLE), hg.circle(*DEST_CIRCLE)
    return _rounded(hg.trip_query(_valid(spark, sf_dir), 1, 500, pickup, dropoff, []))


@register
def trip_stats(spark, sf_dir):
    return _rounded(hg.trip_stats(_valid(spark, sf_dir)))


@register
def minmaxtot_stats(spark, sf_dir):
    stats = hg.trip_stats(sample.trips(spark, sf_dir), SUMMARY_FIELDS)
    return _rounded(stats.select([c for c in stats.columns if not c.startswith("duration") and c != "count"]))


@register
def int_histogram(spark, sf_dir):
    stats = hg.trip_stats(sample.trips(spark, sf_dir), HISTOGRAM_FIELDS)
    return stats.select([c for c in stats.columns if not c.startswith("duration") and c != "count"])


@register
def duration_stats(spark, sf_dir):
    return _rounded(hg.trip_stats(sample.trips(spark, sf_dir), []))


@register
def selected_stats(spark, sf_dir):
    chosen = ["tip_amount", "cab_type", "extra", "trip_type"]
    return _rounded(hg.trip_stats(_valid(spark, sf_dir), chosen))


@register
def merged_stats(spark, sf_dir):
    """Partial statistics per supplier, merged to the whole."""
    fields = statistics.stat_fields()
    parts = _valid(spark, sf_dir).groupBy("l_suppkey").agg(*statistics.partial(fields))
    return _rounded(parts.agg(*statistics.merge(fields)).select(*statistics.finish(fields)))


@register
def stats_json(spark, sf_dir):
    fields = ["fare_amount", "tolls_amount", "cab_type"]
    return hg.stats_json(hg.trip_stats(_valid(spark, sf_dir), fields), fields, scale=4)


# Filters


@register
def valid_trips(spark, sf_dir):
    return _valid(spark, sf_dir).select(*IDS, "pickup_longitude", "pickup_latitude", "time_of_day_sec")


@register
def time_filter(spark, sf_dir):
    return _counted(_valid(spark, sf_dir).where(hg.in_time_of_day(*WINDOW)))


@register
def box_filter(spark, sf_dir):
    return _counted(_valid(spark, sf_dir).where(hg.in_area(hg.box(*BOX_A))))


@register
def trip_filter(spark, sf_dir):
    keep = hg.trip_filter(*WINDOW, hg.box(*BOX_A), hg.box(*BOX_B))
    return _valid(spark, sf_dir).where(keep).select(*IDS, "time_of_day_sec", "fare_amount")


@register
def circle_filter(spark, sf_dir):
    return _counted(_valid(spark, sf_dir).where(hg.in_area(hg.circle(*CIRCLE))))


@register
def polygon_filter(spark, sf_dir):
    return _counted(_valid(spark, sf_dir).where(hg.in_area(hg.polygon(SHELL, HOLE))))


@register
def multi_area_filter(spark, sf_dir):
    pickup = hg.box(*PART_A) | hg.polygon(TRIANGLE)
    dropoff = hg.box(*BOX_B) | hg.box(*PART_B)
    return _counted(_valid(spark, sf_dir).where(hg.trip_filter(pickup=pickup, dropoff=dropoff)))


@register
def spatiotemporal_filter(spark, sf_dir):
    trips = _valid(spark, sf_dir)
    by_role = [
        _counted(trips.where(hg.in_period(*PERIOD, hg.box(*BOX_A), role))).withColumn("role", F.lit(role))
        for role in (PICKUP, DROPOFF)
    ]
    return by_role[0].unionByName(by_role[1])


@register
def feature_scan(spark, sf_dir):
    layer = hg.features(sample.trips(spark, sf_dir))
    rows = layer.where(hg.trip_filter(*WINDOW, hg.circle(*CIRCLE), hg.box(*BOX_B)))
    return rows.select("trip_id", "vendor_id", "fare_amount", "time_of_day_sec")


# Features


def _flat(layer: DataFrame) -> DataFrame:
    """Layer attributes as plain columns; ``attributes`` lists them in layer order."""
    order = ",".join(layer.columns[1:])
    plain = []
    for name in layer.columns:
        if name.endswith("_location"):
            plain += [F.col(f"{name}.x").alias(f"{name}_x"), F.col(f"{name}.y").alias(f"{name}_y")]
        elif name.endswith("_datetime"):
            plain.append(F.unix_seconds(name).alias(name))
        else:
            plain.append(F.col(name))
    return layer.select(*plain, F.lit(order).alias("attributes"))


@register
def features_pickup(spark, sf_dir):
    return _flat(hg.features(sample.trips(spark, sf_dir), PICKUP))


@register
def features_dropoff(spark, sf_dir):
    return _flat(hg.features(sample.trips(spark, sf_dir), DROPOFF))


@register
def trip_id_(spark, sf_dir):
    return _valid(spark, sf_dir).select(*IDS, trip_id().alias("trip_id"))


@register
def trip_duration(spark, sf_dir):
    return sample.trips(spark, sf_dir).select(*IDS, statistics.duration_seconds().alias("duration_sec"))


@register
def time_of_day(spark, sf_dir):
    seconds = parsing.time_of_day(F.unix_seconds("dropoff_datetime"))
    return sample.trips(spark, sf_dir).select(*IDS, "time_of_day_sec", seconds.alias("dropoff_sec"))


@register
def dedup_trips(spark, sf_dir):
    """Trips with every 50th order loaded a second time at another fare."""
    first = sample.trips(spark, sf_dir).withColumn("ingest_seq", F.lit(1))
    again = first.where("mod(l_orderkey, 50) = 0").withColumns(
        {"ingest_seq": F.lit(2), "fare_amount": F.col("fare_amount") + 1.0}
    )
    latest = hg.latest_trips(first.unionByName(again))
    return latest.select(*IDS, "ingest_seq", F.round("fare_amount", 6).alias("fare_amount"))


# Geometry and grid


@register
def search_box(spark, sf_dir):
    places = sample.requests(spark, sf_dir).where("start_lon is not null")
    box = geometry.search_box(F.col("start_lon"), F.col("start_lat"))
    return places.select(
        "request_id", box.xmin.alias("xmin"), box.ymin.alias("ymin"), box.xmax.alias("xmax"), box.ymax.alias("ymax"),
        geometry.area_wkt(box).alias("wkt"),
    )


def _circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample.read(spark, sf_dir, "customer", "nation")
    ring = geometry.circle_ring(F.col("lon"), F.col("lat"))
    return spark.sql(sample.PLACES).select("key", ring.alias("ring"))


@register
def circle_polygon(spark, sf_dir):
    corners = _circles(spark, sf_dir).select("key", F.posexplode("ring").alias("corner", "p"))
    return corners.select("key", "corner", "p.x", "p.y")


@register
def shape_envelope(spark, sf_dir):
    parts = _polygons(spark, sf_dir).select("c_custkey", "name", F.posexplode("parts").alias("part", "rings"))
    e = geometry.ring_envelope(F.get("rings", F.lit(0)))
    return parts.select(
        "c_custkey", F.coalesce("name", F.lit("")).alias("name"), "part",
        e.xmin.alias("xmin"), e.ymin.alias("ymin"), e.xmax.alias("xmax"), e.ymax.alias("ymax"),
    )


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.polygon_features(sample.polygon_documents(spark, sf_dir))


@register
def polygon_layer(spark, sf_dir):
    points = (
        _polygons(spark, sf_dir)
        .select("c_custkey", "name", "borough", F.posexplode("parts").alias("part", "rings"))
        .select("*", F.posexplode("rings").alias("ring", "points"))
        .select("*", F.posexplode("points").alias("corner", "p"))
    )
    return points.select(
        "c_custkey", F.coalesce("name", F.lit("")).alias("name"), "borough", "part", "ring", "corner", "p.x", "p.y"
    )


@register
def grid_cell(spark, sf_dir):
    trips = sample.trips(spark, sf_dir)
    parts = [trips.select(*IDS, F.lit(bias).alias("bias"), *grid.grid_cells(bias)) for bias in grid.BIAS_BITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Requests


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.with_departure(sample.requests(spark, sf_dir))


def _match(spark: SparkSession, sf_dir: str, **limits) -> DataFrame:
    keys = [*est.PLACES, "start_sec"]
    windows = _asked(spark, sf_dir).where(" and ".join(f"{k} is not null" for k in keys)).select(*keys).distinct()
    window = hg.Window(
        geometry.search_box(F.col("start_lon"), F.col("start_lat"), 0.0123),
        geometry.search_box(F.col("dest_lon"), F.col("dest_lat"), 0.0082),
        F.col("start_sec") - 1500,
        F.col("start_sec") + 1500,
    )
    stats = hg.window_stats(windows, window, _valid(spark, sf_dir, spread=True), keys, ["tip_amount"], **limits)
    return _rounded(stats.select(*keys, *statistics.finish(["tip_amount"])), REQUEST_PLACES)


@register
def requests_match(spark, sf_dir):
    """Trips around each distinct request at a fixed window."""
    return _match(spark, sf_dir)


@register
def requests_match_crowded(spark, sf_dir):
    """The same, with both sides shuffled and the fuller cells split."""
    return _match(spark, sf_dir, broadcast_cells=0, hot_trips=200, hot_windows=100, hot_pairs=10_000)


def _areas(spark: SparkSession, sf_dir: str, **limits) -> DataFrame:
    sample.read(spark, sf_dir, "customer")
    windows = spark.sql(sample.WINDOWS)
    half, round_ = F.col("half"), F.col("round")
    start = geometry.search_box(F.col("x"), F.col("y"), half)
    start = geometry.RowArea(start.xmin, start.ymin, start.xmax, start.ymax, F.when(round_, F.col("x")), F.when(round_, F.col("y")), F.when(round_, half))
    end = geometry.search_box(F.col("to_x"), F.col("to_y"), F.col("to_half"))
    window = hg.Window(start, end, F.col("middle") - F.col("reach"), F.col("middle") + F.col("reach"))
    stats = hg.area_stats(windows, window, _valid(spark, sf_dir, spread=True), ["c_custkey"], ["passenger_count", "cab_type"], **limits)
    return _rounded(stats.select("c_custkey", *statistics.finish(["passenger_count", "cab_type"])))


@register
def area_match(spark, sf_dir):
    """Trips of windows of many sizes, by the nodes of one tree."""
    return _areas(spark, sf_dir)


@register
def area_match_sampled(spark, sf_dir):
    """The same by a tree from a part of the trips, with full nodes cut."""
    return _areas(spark, sf_dir, leaf_trips=20, sample_trips=500, hot_trips=50, hot_pairs=1000)


def _estimate(spark: SparkSession, sf_dir: str, **limits) -> DataFrame:
    answers = hg.estimate(_valid(spark, sf_dir, spread=True), _asked(spark, sf_dir), ["fare_amount", "payment_type"], **limits)
    return _rounded(answers.drop(*est.PLACES, *est.ADDRESSES, "start_time"), REQUEST_PLACES)


@register
def estimate(spark, sf_dir):
    return _estimate(spark, sf_dir)


@register
def estimate_shuffled(spark, sf_dir):
    """The same, with trips and requests shuffled by cell."""
    return _estimate(spark, sf_dir, broadcast_cells=0)


@register
def trip_card(spark, sf_dir):
    fields = ["trip_distance", "fare_amount", "tolls_amount"]
    return hg.trip_card(hg.estimate(_valid(spark, sf_dir, spread=True), _asked(spark, sf_dir), fields))


@register
def estimate_address(spark, sf_dir):
    asked = hg.geocode_requests(_asked(spark, sf_dir), sample.responses(spark, sf_dir))
    answers = hg.estimate_address(_valid(spark, sf_dir, spread=True), asked, ["fare_amount", "cab_type"])
    hidden = [c for c in asked.columns if c not in ("request_id", "start_sec")]
    return _rounded(answers.drop(*hidden), REQUEST_PLACES)


@register
def estimate_json(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    keyed = asked.withColumns(
        {
            "start_place": geometry.place_key(F.col("start_lon"), F.col("start_lat")),
            "dest_place": geometry.place_key(F.col("dest_lon"), F.col("dest_lat")),
        }
    )
    answers = hg.estimate(_valid(spark, sf_dir, spread=True), keyed, ["cab_type"])
    located = hg.geocode_requests(answers, sample.reverse_responses(spark, sf_dir), "start_place", "dest_place")
    ends = located.withColumns(
        {
            "start_area": est.matched_area(F.col("start_lon"), F.col("start_lat"), F.col("level")),
            "dest_area": est.matched_area(F.col("dest_lon"), F.col("dest_lat"), F.col("level")),
        }
    )
    return hg.estimate_json(ends, ["cab_type"], scale=4)


@register
def trip_info(spark, sf_dir):
    """The reply to each of a table of requests by coordinates, by addresses, by both or by neither, read back."""
    responses = sample.responses(spark, sf_dir).unionByName(sample.reverse_responses(spark, sf_dir))
    info = hg.trip_info(_valid(spark, sf_dir, spread=True), sample.mixed_requests(spark, sf_dir), responses)
    replies = hg.estimate_json(info, REPLY_FIELDS)
    stats = ["duration", *[n for n in REPLY_FIELDS if n in SUMMARY_FIELDS]]
    bins = {n: [str(b) for b in BY_NAME[n].stat.bins] for n in REPLY_FIELDS if n in HISTOGRAM_FIELDS}
    summary, address = "struct<min:double,max:double,total:double,avg:double>", "struct<formatted_address:string>"
    members = ["count:long", *[f"{n}:{summary}" for n in stats], *[f"{n}:struct<{','.join(f'`{b}`:long' for b in own)}>" for n, own in bins.items()]]
    full = f"struct<stats:struct<{','.join(members)}>,startGeom:string,destGeom:string,startAddressInfo:{address},destAddressInfo:{address}>"
    read = replies.withColumn("r", F.from_json("reply", full)).join(info.select("request_id", "kind", "matched", "level"), "request_id")
    shift = {"avg": TIE_SHIFT}
    flat = [F.round(F.col(f"r.stats.{n}.{k}") + shift.get(k, 0.0), REQUEST_PLACES).alias(f"{n}_{k}") for n in stats for k in ("min", "max", "total", "avg")]
    flat += [F.col(f"r.stats.{n}.`{b}`").alias(f"{n}_{b}") for n, own in bins.items() for b in own]
    return read.select(
        "request_id", "kind", "matched", "level", F.col("r.stats.count").alias("count"), *flat,
        F.regexp_extract("reply", r'\[\[("[^"]*"|null),', 1).alias("departure"),
        F.substring("r.startGeom", 1, 9).alias("start_geom"), F.substring("r.destGeom", 1, 9).alias("dest_geom"),
        F.col("r.startAddressInfo.formatted_address").alias("start"), F.col("r.destAddressInfo.formatted_address").alias("dest"),
    )


@register
def departures(spark, sf_dir):
    return _asked(spark, sf_dir).select("request_id", "departure", "start_sec")


# Geocoding


@register
def geocode_area(spark, sf_dir):
    area = geometry.RowArea.of("area")
    return hg.geocode(sample.responses(spark, sf_dir)).select(
        "key", area.xmin.alias("xmin"), area.ymin.alias("ymin"), area.xmax.alias("xmax"), area.ymax.alias("ymax"),
        F.round(area.radius, 6).alias("radius"), geometry.area_wkt(area).alias("wkt"),
    )


@register
def geocode_address(spark, sf_dir):
    return hg.geocode(sample.responses(spark, sf_dir)).select(
        "key", F.col("address_info.formatted_address").alias("address"),
        F.size("address_info.address_components").alias("components"),
    )


@register
def address_lookup(spark, sf_dir):
    return _looked_up(spark, sf_dir)


@register
def address_lookup_large(spark, sf_dir):
    """The same, as for responses too large to broadcast, with keys that many requests ask for."""
    return _looked_up(spark, sf_dir, broadcast_rows=0, hot_rows=20)


def _looked_up(spark: SparkSession, sf_dir: str, **limits) -> DataFrame:
    asked = hg.geocode_requests(sample.requests(spark, sf_dir), sample.responses(spark, sf_dir), **limits)
    return asked.select(
        "request_id", F.col("start_address_info.formatted_address").alias("start"),
        F.col("dest_address_info.formatted_address").alias("dest"), F.col("dest_area.xmin").alias("dest_xmin"),
    )


@register
def address_cache_(spark, sf_dir):
    """Addresses looked up by way of a store: half of the requests, then all, then all once the answers are too old."""
    store = sample.new_folder(spark, "answers")
    responses, every = sample.responses(spark, sf_dir), sample.requests(spark, sf_dir)
    parts = []
    for now, asked, max_age in ((10, every.where("mod(request_id, 2) = 0"), None), (25, every, 20), (100, every, 20)):
        found, counts = address_cache.geocode_with_store(asked, responses, store, now, max_age)
        parts.append(
            found.groupBy("start_age", F.col("start_address_info.formatted_address").alias("start"), F.col("dest_area.xmin").alias("dest_xmin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumns({"load": F.lit(now), **{k: F.lit(v).cast("long") for k, v in counts.items()}})
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Zones


def _zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.polygon_features(sample.zone_documents(spark, sf_dir)).select("borough", F.col("name").alias("zone"), "parts")


def _by_borough(spark: SparkSession, sf_dir: str, **limits) -> DataFrame:
    """Statistics of the trips that start in each zone; a trip counts once in each of the zones that have its start."""
    stats = hg.zone_stats(_valid(spark, sf_dir, spread=True), _zoned(spark, sf_dir), ["borough", "zone"], ["passenger_count", "payment_type"], **limits)
    return _rounded(stats.select("borough", "zone", *statistics.finish(["passenger_count", "payment_type"])))


@register
def trips_by_borough(spark, sf_dir):
    return _by_borough(spark, sf_dir)


@register
def trips_by_borough_shuffled(spark, sf_dir):
    """The same with a finer grid, and trips and cells shuffled."""
    return _by_borough(spark, sf_dir, step=0.0013, broadcast_cells=0)


@register
def trips_in_zones(spark, sf_dir):
    """Each trip with the zones of its drop-off."""
    return hg.trips_in_zones(_valid(spark, sf_dir, spread=True), _zoned(spark, sf_dir), ["borough", "zone"], DROPOFF).select(*IDS, "borough", "zone")


# Statistics of one's own


@register
def sketch_stats(spark, sf_dir):
    """Distinct values and quantiles by sketches of each supplier's trips, merged, held against exact ones."""
    fields = ["fare_amount", "trip_distance", "tip_amount", "time_of_day_sec"]
    chosen = {n: ["quantiles", "distinct", "spread"] for n in fields}
    trips = _valid(spark, sf_dir)
    merged = trips.groupBy("l_suppkey").agg(*pluggable.partial(chosen)).agg(*pluggable.merge(chosen)).select(*pluggable.finish(chosen))
    out = None
    for n in fields:
        shares = {f"q{p}": F.col(f"{n}_quantiles_q{p}") for p in (25, 50, 75, 95)}
        asked = merged.select(F.col(f"{n}_distinct_distinct").alias("about"), F.col(f"{n}_spread_mean").alias("mean"), F.col(f"{n}_spread_variance").alias("variance"), *[c.alias(q) for q, c in shares.items()])
        # Shares of the rows below a value and up to it: a quantile lies between them, but for the sketch's error.
        exact = trips.crossJoin(F.broadcast(asked)).groupBy("about", "mean", "variance").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct(n).alias("exact"),
            *[F.avg((F.col(n) < F.col(q)).cast("double")).alias(f"{q}_low") for q in shares],
            *[F.avg((F.col(n) <= F.col(q)).cast("double")).alias(f"{q}_high") for q in shares],
        )
        near = [((F.col(f"q{p}_low") <= p / 100 + 0.02) & (F.col(f"q{p}_high") >= p / 100 - 0.02)).alias(f"q{p}_within") for p in (25, 50, 75, 95)]
        part = exact.select(
            F.lit(n).alias("field"), "n", F.col("exact").alias("distinct_exact"), (F.abs(F.col("about") - F.col("exact")) <= 0.08 * F.col("exact")).alias("distinct_within"),
            F.round("mean", 6).alias("mean"), F.round("variance", 2).alias("variance"), *near,
        )
        out = part if out is None else out.unionByName(part)
    return out


# Layers


@register
def heatmap_tiles(spark, sf_dir):
    return hg.heatmap_tiles(_valid(spark, sf_dir), PICKUP)


@register
def point_tiles(spark, sf_dir):
    """At most 40 points a tile, of six zooms, chosen by a digest that both engines know."""
    tiles = hg.point_tiles(_valid(spark, sf_dir), DROPOFF, most=40, order=F.md5(trip_id().cast("binary")))
    return tiles.withColumn("time", F.unix_seconds("time"))


@register
def heatmap_pickup(spark, sf_dir):
    return hg.heatmap(_valid(spark, sf_dir), PICKUP)


@register
def heatmap_dropoff(spark, sf_dir):
    return hg.heatmap(_valid(spark, sf_dir), DROPOFF)


@register
def point_layer(spark, sf_dir):
    parts = []
    for role in (PICKUP, DROPOFF):
        layer = hg.point_layer(_valid(spark, sf_dir), hg.box(*BOX_A), role)
        parts.append(layer.select(F.lit(role).alias("role"), "x", "y", F.unix_seconds("time").alias("time")))
    return parts[0].unionByName(parts[1])


# Reading CSV


@register
def parse_trips(spark, sf_dir):
    trips = hg.parse_lines(sample.lines(spark, sf_dir), sample.HEADERS)
    names = [f.name for f in STAGED_FIELDS]
    plain = {n: F.unix_seconds(n) for n in names if n.endswith("_datetime")}
    plain["extra"] = F.col("extra").cast("string")  # may be NaN
    return trips.select(*[plain.get(n, F.col(n)).alias(n) for n in names])


@register
def header_mapping(spark, sf_dir):
    audit = hg.header_mapping(sample.lines(spark, sf_dir))
    return audit.select("header", "position", "cell", F.coalesce("field", F.lit("")).alias("field"), "n_lines")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample.read(spark, sf_dir, "lineitem")
    return spark.sql(sample.spark_cells())


@register
def parse_datetime(spark, sf_dir):
    seconds = parsing.lenient_epoch_seconds(F.col("pickup"))
    return _cells(spark, sf_dir).select(*IDS, "mode", seconds.alias("pickup_sec"))


@register
def parse_numbers(spark, sf_dir):
    return _cells(spark, sf_dir).select(
        *IDS,
        F.coalesce(parsing.parse_int(F.col("passengers")), F.lit(0)).alias("passengers"),
        F.coalesce(parsing.parse_int(F.col("rate")), F.lit(0)).alias("rate"),
        F.coalesce(parsing.parse_double(F.col("extra")), F.lit(0.0)).cast("string").alias("extra"),
        F.coalesce(parsing.parse_double(F.col("plon")), F.lit(0.0)).alias("lon"),
    )


@register
def norm_vendor(spark, sf_dir):
    return _cells(spark, sf_dir).select(*IDS, parsing.vendor_code(F.col("vendor")).alias("vendor_id"))


@register
def norm_flag(spark, sf_dir):
    return _cells(spark, sf_dir).select(*IDS, parsing.flag(F.col("flag")).alias("flag"))


@register
def norm_payment(spark, sf_dir):
    code = F.coalesce(parsing.payment_code(F.col("payment")), F.lit(0))
    return _cells(spark, sf_dir).select(*IDS, code.alias("payment_type"))


@register
def cab_type(spark, sf_dir):
    lines = sample.lines(spark, sf_dir)
    return lines.groupBy("file_name", parsing.cab_code(F.col("file_name")).alias("cab_type")).agg(
        F.count(F.lit(1)).alias("n")
    )


# From files to stored layers


def _stored(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Both layers of the sample's CSV files; the last file kind comes as a second load."""
    csv, staged = sample.csv_files(spark, sf_dir), sample.new_folder(spark, "staged")
    hg.stage(spark, csv, staged, ingest_seq=0)
    paths = {}
    for role in (PICKUP, DROPOFF):
        paths[role] = sample.new_folder(spark, f"layer-{role}")
        hg.build_layer(spark, staged, paths[role], role)
    return paths


# What a trip is known by.
PLACES = [f"{role}_{name}" for role in (PICKUP, DROPOFF) for name in ("longitude", "latitude")]


def _known_by(rows: DataFrame) -> DataFrame:
    times = [F.unix_seconds(f"{role}_datetime").alias(f"{role}_sec") for role in (PICKUP, DROPOFF)]
    return rows.select(*times, *PLACES)


@register
def csv_to_layer(spark, sf_dir):
    """Files of several headers, staged and stored: the trips of both layers by hour."""
    parts = []
    for role, path in _stored(spark, sf_dir).items():
        rows = _known_by(spark.read.parquet(path)).withColumn("hour", F.floor(F.pmod("pickup_sec", F.lit(86400)) / 3600).cast("int"))
        counted = rows.groupBy("hour").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dropoff_sec") - F.col("pickup_sec")).alias("seconds"))
        parts.append(counted.withColumn("role", F.lit(role)))
    return parts[0].unionByName(parts[1])


@register
def stored_layer_scan(spark, sf_dir):
    """Trips of a stored layer between two areas at a time of day."""
    path = _stored(spark, sf_dir)[DROPOFF]
    return _known_by(hg.scan_layer(spark, path, DROPOFF, *WINDOW, hg.box(*BOX_A), hg.box(*BOX_B)))


@register
def stored_trip_query(spark, sf_dir):
    """Count and durations of a stored layer's trips that start in a circle."""
    rows = hg.scan_layer(spark, _stored(spark, sf_dir)[PICKUP], PICKUP, *WINDOW, pickup=hg.circle(*CIRCLE))
    return hg.trip_stats(rows, [])


@register
def upsert_layer(spark, sf_dir):
    """A stored layer after a second load that repeats some of its trips and brings others."""
    base = sample.trips(spark, sf_dir).withColumn("ingest_seq", F.lit(0).cast("long"))
    path = sample.new_folder(spark, "layer")
    hg.write_layer(base.where("mod(l_orderkey, 3) <> 0"), path, sequence="ingest_seq")
    load = base.where("mod(l_orderkey, 2) = 0 or mod(l_orderkey, 3) = 0").withColumn("fare_amount", F.lit(-1.0))
    hg.upsert_layer(load, path, sequence="ingest_seq")
    rows = spark.read.parquet(path).withColumn("fresh", F.col("fare_amount") == -1)
    return rows.groupBy("fresh").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.unix_seconds("pickup_datetime")).alias("pickup_sum"), F.sum(F.unix_seconds("dropoff_datetime")).alias("dropoff_sum")
    )


@register
def layer_merge_read(spark, sf_dir):
    """A layer of four loads, each repeating trips of those before, read before and after compaction and at an older version."""
    base = sample.trips(spark, sf_dir).withColumn("ingest_seq", F.lit(0).cast("long"))
    path = sample.new_folder(spark, "versions")
    loads = ("true", "mod(l_orderkey, 2) = 0", "mod(l_orderkey, 3) = 0", "mod(l_orderkey, 7) = 0 and pickup_longitude < -74.0")
    for i, rows in enumerate(loads):
        hg.append_load(base.where(rows).withColumn("passenger_count", F.lit(i).cast("int")), path, sequence="ingest_seq")

    def counted(state: str, **how) -> DataFrame:
        rows = hg.read_versioned(spark, path, **how)
        return rows.groupBy("passenger_count").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.unix_seconds("pickup_datetime")).alias("pickup_sum"), F.lit(state).alias("state")
        )

    parts = [counted("merged"), counted("area", start_sec=WINDOW[0], end_sec=WINDOW[1], pickup=hg.box(*BOX_A)), counted("second", at=2)]
    hg.compact(spark, path, overlap=0.05)
    parts += [counted("compacted"), counted("compacted second", at=2)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
