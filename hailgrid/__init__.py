"""Geo-temporal analytics of taxi trips on Spark."""

from hailgrid.functions.geometry import Area, RowArea, box, box_around, circle, circle_area, polygon, search_box
from hailgrid.functions.pluggable import custom_stats
from hailgrid.functions.statistics import stats_json, trip_stats
from hailgrid.operators.address_cache import geocode_with_store
from hailgrid.operators.area_match import area_stats
from hailgrid.operators.density import heatmap, point_layer
from hailgrid.operators.estimate import estimate, estimate_address, estimate_json, trip_card, with_departure
from hailgrid.operators.features import features, latest_trips
from hailgrid.operators.filters import in_area, in_period, in_time_of_day, trip_filter, valid_trips
from hailgrid.operators.geocoding import geocode, geocode_requests
from hailgrid.operators.matching import Window, window_stats
from hailgrid.operators.tiles import heatmap_tiles, point_tiles
from hailgrid.operators.trip_info import trip_info, trip_info_json
from hailgrid.operators.zones import trips_in_zones, zone_stats
from hailgrid.plans.ingest import build_layer, extend_layer, stage
from hailgrid.plans.trip_query import trip_query
from hailgrid.sources.headers import header_mapping
from hailgrid.sources.polygon_layers import polygon_features, read_polygon_layer
from hailgrid.sources.trip_csv import parse_lines, read_trips
from hailgrid.sources.trip_store import read_staged, scan_layer, upsert_layer, write_json, write_layer, write_staged
from hailgrid.sources.versioned_layer import append_load, compact, current_version, read_versioned

__all__ = [
    "Area",
    "RowArea",
    "Window",
    "append_load",
    "area_stats",
    "box",
    "box_around",
    "build_layer",
    "circle",
    "circle_area",
    "compact",
    "current_version",
    "custom_stats",
    "estimate",
    "estimate_address",
    "estimate_json",
    "extend_layer",
    "features",
    "geocode",
    "geocode_requests",
    "geocode_with_store",
    "header_mapping",
    "heatmap",
    "heatmap_tiles",
    "in_area",
    "in_period",
    "in_time_of_day",
    "latest_trips",
    "parse_lines",
    "point_layer",
    "point_tiles",
    "polygon",
    "polygon_features",
    "read_polygon_layer",
    "read_staged",
    "read_trips",
    "read_versioned",
    "scan_layer",
    "search_box",
    "stage",
    "stats_json",
    "trip_card",
    "trip_filter",
    "trip_info",
    "trip_info_json",
    "trip_query",
    "trip_stats",
    "trips_in_zones",
    "upsert_layer",
    "valid_trips",
    "window_stats",
    "with_departure",
    "write_json",
    "write_layer",
    "write_staged",
    "zone_stats",
]
