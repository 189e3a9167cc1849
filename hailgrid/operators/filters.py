"""Trip predicates and filtered scans.

Each predicate is a plain conjunction of comparisons on the position and time
columns, so Spark pushes the envelopes down to the Parquet row groups and tests
the exact shape only on rows that pass.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hailgrid.functions.geometry import BASE_BUFFER, Area
from hailgrid.functions.grid import BLOCK_LEVEL, MAX_LAT, MAX_LON, MIN_LAT, MIN_LON

PICKUP, DROPOFF = "pickup", "dropoff"


def position(role: str) -> tuple[str, str]:
    """Longitude and latitude columns of one end of a trip."""
    if role not in (PICKUP, DROPOFF):
        raise ValueError(f"role must be {PICKUP!r} or {DROPOFF!r}, not {role!r}")
    return f"{role}_longitude", f"{role}_latitude"


def is_valid() -> Column:
    """Trips with real coordinates that do not start exactly at midnight.

    Zero stands for a value that could not be parsed.
    """
    valid = F.col("time_of_day_sec") != 0
    for role in (PICKUP, DROPOFF):
        for name in position(role):
            valid = valid & (F.col(name) != 0)
    return valid


def valid_trips(trips: DataFrame) -> DataFrame:
    return trips.where(is_valid())


def in_time_of_day(start_sec: int, end_sec: int) -> Column:
    """Pickup second of day between both bounds, inclusive; no wrap at midnight."""
    return F.col("time_of_day_sec").between(start_sec, end_sec)


def in_area(area: Area, role: str = PICKUP) -> Column:
    return area.covers(*position(role))


def trip_filter(
    start_sec: int | None = None,
    end_sec: int | None = None,
    pickup: Area | None = None,
    dropoff: Area | None = None,
) -> Column:
    """Time of day and both ends of the trip; parts left out do not restrict."""
    keep = F.lit(True)
    if start_sec is not None:
        keep = keep & (F.col("time_of_day_sec") >= start_sec)
    if end_sec is not None:
        keep = keep & (F.col("time_of_day_sec") <= end_sec)
    if pickup is not None:
        keep = keep & in_area(pickup, PICKUP)
    if dropoff is not None:
        keep = keep & in_area(dropoff, DROPOFF)
    return keep


def instant(moment: datetime) -> Column:
    """A point in time; without a zone it is UTC, whatever the zones of driver and session."""
    aware = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    since = aware - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(since // timedelta(microseconds=1)))


def in_period(start: datetime, end: datetime, area: Area, role: str = PICKUP) -> Column:
    """Absolute time range and area on the point and time of one layer."""
    return F.col(f"{role}_datetime").between(instant(start), instant(end)) & in_area(area, role)


def area_blocks(area: Area) -> list[int]:
    """Blocks (coarse cells, see ``grid.block``) an area touches.

    Computed with the same floating-point steps as the column form.
    """

    def span(low: float, high: float, first: float, last: float) -> range:
        ends = [int((min(max(v, first), last) - first) / BASE_BUFFER) >> BLOCK_LEVEL for v in (low, high)]
        return range(ends[0], ends[1] + 1)

    blocks = set()
    for xmin, ymin, xmax, ymax in area.envelopes:
        for x in span(xmin, xmax, MIN_LON, MAX_LON):
            blocks.update(x * 16 + y for y in span(ymin, ymax, MIN_LAT, MAX_LAT))
    return sorted(blocks)
