"""Map layers: points in the viewport and density of trip ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailgrid.functions.geometry import Area, box
from hailgrid.functions.grid import MAX_LAT, MAX_LON, MIN_LAT, MIN_LON
from hailgrid.operators.filters import PICKUP, in_area, position

# The map's outer bounds in degrees (west, south, east, north)
# and the weights of a 5-point Gaussian kernel (each row sums to 16).
VIEWPORT = box(-74.5147705078125, 40.31513750307456, -73.37493896484374, 41.10005163093046)
KERNEL = (1, 4, 6, 4, 1)


def point_layer(trips: DataFrame, viewport: Area = VIEWPORT, role: str = PICKUP) -> DataFrame:
    """Points of one layer inside a viewport: ``x``, ``y`` and the time of that end."""
    lon, lat = position(role)
    return trips.where(in_area(viewport, role)).select(
        F.col(lon).alias("x"), F.col(lat).alias("y"), F.col(f"{role}_datetime").alias("time")
    )


def heatmap(trips: DataFrame, role: str = PICKUP, cells: int = 256) -> DataFrame:
    """Kernel density of one trip end on a ``cells`` x ``cells`` grid of the city box.

    Trips are counted per cell first, with partial counts before the shuffle, so
    a busy cell costs no more than an empty one. The kernel is spread over the
    counts (at most ``cells ** 2`` rows). Points outside the box are left out;
    so is kernel weight that falls outside. ``density`` is in trips per cell.
    """
    lon, lat = position(role)
    step_x, step_y = (MAX_LON - MIN_LON) / cells, (MAX_LAT - MIN_LAT) / cells
    counts = (
        trips.where(in_area(box(MIN_LON, MIN_LAT, MAX_LON, MAX_LAT), role))
        .groupBy(
            F.least(F.floor((F.col(lon) - MIN_LON) / step_x), F.lit(cells - 1)).alias("x"),
            F.least(F.floor((F.col(lat) - MIN_LAT) / step_y), F.lit(cells - 1)).alias("y"),
        )
        .count()
    )
    reach = len(KERNEL) // 2
    offsets = F.array(
        *[
            F.struct(F.lit(i - reach).alias("dx"), F.lit(j - reach).alias("dy"), F.lit(a * b).alias("weight"))
            for i, a in enumerate(KERNEL)
            for j, b in enumerate(KERNEL)
        ]
    )
    spread = counts.select("x", "y", "count", F.explode(offsets).alias("o")).select(
        (F.col("x") + F.col("o.dx")).alias("x"),
        (F.col("y") + F.col("o.dy")).alias("y"),
        (F.col("count") * F.col("o.weight")).alias("weighted"),
    )
    inside = F.col("x").between(0, cells - 1) & F.col("y").between(0, cells - 1)
    # Whole weights are summed, so the result does not depend on their order.
    return (
        spread.where(inside)
        .groupBy("x", "y")
        .agg((F.sum("weighted") / float(sum(KERNEL) ** 2)).alias("density"))
    )
