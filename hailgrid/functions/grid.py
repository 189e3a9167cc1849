"""Grid cells over the city box and the hours of a day.

Positions outside the box are clamped to its edge, so the grid stays dense;
filters always use the real coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hailgrid.functions.geometry import BASE_BUFFER

# The city box in degrees, the length of a day in seconds, and
# the bits of the space and time axes for each bias.
MIN_LON, MAX_LON = -74.375, -73.575
MIN_LAT, MAX_LAT = 40.3, 41.1
DAY_SECONDS = 86400
BIAS_BITS = {
    "temporal": (7, 34),
    "balanced": (12, 12),
    "spatial": (14, 6),
}

_AXES = {"lon": (MIN_LON, MAX_LON), "lat": (MIN_LAT, MAX_LAT), "time": (0.0, float(DAY_SECONDS))}

# Search cells: the finest side is one search buffer (10 minutes of time); each
# level doubles it. At LAST_LEVEL one cell spans a whole axis.
TIME_STEP = 600
LAST_LEVEL = 8
# Blocks are the coarse cells a stored layer is partitioned by (13 x 13).
BLOCK_LEVEL = 4


def bias_bits(bias: str) -> tuple[int, int]:
    """(space bits, time bits) of a bias name in any case."""
    try:
        return BIAS_BITS[bias.lower()]
    except KeyError:
        raise ValueError(f"unknown bias {bias!r}; one of {sorted(BIAS_BITS)}") from None


def clamp(value: Column, axis: str) -> Column:
    low, high = _AXES[axis]
    return F.least(F.greatest(value.cast("double"), F.lit(low)), F.lit(high))


def axis_cell(value: Column, axis: str, bits: int) -> Column:
    """Cell number of a clamped value among ``2**bits`` equal cells."""
    low, high = _AXES[axis]
    cell = F.floor((clamp(value, axis) - low) / (high - low) * float(2**bits))
    return F.least(cell, F.lit(2**bits - 1))


def grid_cells(bias: str = "balanced") -> list[Column]:
    """The five cell columns of a trip."""
    space, time = bias_bits(bias)
    return [
        axis_cell(F.col("pickup_longitude"), "lon", space).alias("pickup_x"),
        axis_cell(F.col("pickup_latitude"), "lat", space).alias("pickup_y"),
        axis_cell(F.col("dropoff_longitude"), "lon", space).alias("dropoff_x"),
        axis_cell(F.col("dropoff_latitude"), "lat", space).alias("dropoff_y"),
        axis_cell(F.col("time_of_day_sec"), "time", time).alias("time_cell"),
    ]


def fine_cell(value: Column, axis: str, parts: int = 1) -> Column:
    """Finest search cell of a position (clamped), or its number among ``parts`` of each; non-decreasing in ``value``."""
    step = (float(TIME_STEP) if axis == "time" else BASE_BUFFER) / parts
    return F.floor((clamp(value, axis) - _AXES[axis][0]) / step).cast("int")


def block_column(role: str) -> str:
    """Name of the block column of a stored layer."""
    return f"{role}_block"


def block(lon: Column, lat: Column) -> Column:
    """Coarse cell number of a position, for laying out a stored layer."""
    x = F.shiftright(fine_cell(lon, "lon"), BLOCK_LEVEL)
    y = F.shiftright(fine_cell(lat, "lat"), BLOCK_LEVEL)
    return x * 16 + y
