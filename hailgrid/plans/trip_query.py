"""The trip query: filter trips and summarise them in one pass."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from hailgrid.functions import statistics
from hailgrid.functions.geometry import Area
from hailgrid.operators.filters import trip_filter


def trip_query(
    trips: DataFrame,
    start_sec: int,
    end_sec: int,
    pickup: Area,
    dropoff: Area,
    fields: Iterable[str] | None = None,
) -> DataFrame:
    """One row of statistics over the trips between two areas at a time of day.

    Always one row: with no trip the count is 0 and the rest NULL.
    """
    return statistics.trip_stats(trips.where(trip_filter(start_sec, end_sec, pickup, dropoff)), fields)
