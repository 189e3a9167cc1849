"""Map layers for every zoom: density and points per tile.

Both read the trips once, at the finest zoom, and keep no more than a grid of cells or a
bounded sample per tile; the wider zooms are made of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hailgrid.checkpoints import keep
from hailgrid.functions.geometry import box
from hailgrid.functions.grid import MAX_LAT, MAX_LON, MIN_LAT, MIN_LON
from hailgrid.operators.density import KERNEL
from hailgrid.operators.filters import PICKUP, in_area, position

CITY = box(MIN_LON, MIN_LAT, MAX_LON, MAX_LAT)
# A tile is 16 x 16 cells.
TILE_BITS = 4


def _place(role: str, cells: int) -> tuple[Column, Column]:
    """Cell of a trip's end on a grid of ``cells`` x ``cells`` over the city box."""
    lon, lat = position(role)
    step_x, step_y = (MAX_LON - MIN_LON) / cells, (MAX_LAT - MIN_LAT) / cells
    return (
        F.least(F.floor((F.col(lon) - MIN_LON) / step_x), F.lit(cells - 1)).cast("int"),
        F.least(F.floor((F.col(lat) - MIN_LAT) / step_y), F.lit(cells - 1)).cast("int"),
    )


def _zooms(rows: DataFrame, finest: int, zooms: int) -> DataFrame:
    """Each row of the finest zoom with its ``zoom, x, y`` at every zoom."""
    places = [F.struct(F.lit(finest - up).alias("zoom"), F.shiftright("x", up).alias("x"), F.shiftright("y", up).alias("y")) for up in range(zooms)]
    return rows.select(*[c for c in rows.columns if c not in ("x", "y")], F.inline(F.array(*places)))


def _smoothed(counts: DataFrame, axis: str) -> DataFrame:
    """One pass of the kernel, along one axis."""
    reach = len(KERNEL) // 2
    steps = F.array(*[F.struct(F.lit(i - reach).alias("by"), F.lit(w).alias("weight")) for i, w in enumerate(KERNEL)])
    spread = counts.select("zoom", "x", "y", "n", F.inline(steps)).withColumn(axis, F.col(axis) + F.col("by"))
    inside = F.col(axis).between(0, F.pow(F.lit(2.0), F.col("zoom")).cast("int") - 1)
    return spread.where(inside).groupBy("zoom", "x", "y").agg(F.sum(F.col("n") * F.col("weight")).alias("n"))


def heatmap_tiles(trips: DataFrame, role: str = PICKUP, finest: int = 8, zooms: int = 6) -> DataFrame:
    """Density of one trip end at several zooms: ``zoom, tile_x, tile_y, x, y, density``.

    At zoom z the city box has 2^z x 2^z cells; ``density`` is in trips per cell, smoothed by the kernel
    of ``heatmap`` at each zoom. Trips are counted once, in the finest cells, and the cells of a zoom are
    sums of those below. The kernel is applied along x, then along y: 10 rows a cell instead of 25.
    Points outside the box are left out, as is weight that falls outside.
    """
    if not 0 < zooms <= finest + 1:
        raise ValueError("there is a zoom for each halving of the finest grid")
    x, y = _place(role, 1 << finest)
    finest_counts = keep(trips.where(in_area(CITY, role)).groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("n")))
    counts = _zooms(finest_counts, finest, zooms).groupBy("zoom", "x", "y").agg(F.sum("n").alias("n"))
    smooth = _smoothed(_smoothed(counts, "x"), "y")
    # Whole weights are summed, so the result does not depend on their order.
    return smooth.select(
        "zoom", F.shiftright("x", TILE_BITS).alias("tile_x"), F.shiftright("y", TILE_BITS).alias("tile_y"), "x", "y", (F.col("n") / float(sum(KERNEL) ** 2)).alias("density")
    )


def point_tiles(trips: DataFrame, role: str = PICKUP, most: int = 100, finest: int = 6, zooms: int = 6, order: Column | None = None) -> DataFrame:
    """Points of one layer for a map at several zooms: ``zoom, tile_x, tile_y, n_points, x, y, time``.

    At zoom z the city box has 2^z x 2^z tiles. A tile shows all its points if there are ``most`` or fewer, else the
    ``most`` with the least ``order``, by default a hash of the trip's ends and times: an even sample that
    stays the same between runs, and of which a wider tile shows a part. ``n_points`` counts all of the tile's points.
    The sample of a tile is made of the samples of the tiles in it, so trips are read once and a
    busy tile is cut to its sample before the shuffle.
    """
    lon, lat = position(role)
    if order is None:
        order = F.xxhash64(*[c for r in ("pickup", "dropoff") for c in (*position(r), f"{r}_datetime")])
    x, y = _place(role, 1 << finest)
    points = trips.where(in_area(CITY, role)).select(
        x.alias("x"), y.alias("y"), F.col(lon).alias("point_x"), F.col(lat).alias("point_y"), F.col(f"{role}_datetime").alias("time"), order.alias("order")
    )

    def sample(rows: DataFrame, tile: list[str]) -> DataFrame:
        window = Window.partitionBy(*tile).orderBy("order", "point_x", "point_y", "time")
        return rows.withColumn("place", F.row_number().over(window)).where(F.col("place") <= most).drop("place")

    counted = keep(points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    counts = _zooms(counted, finest, zooms).groupBy("zoom", "x", "y").agg(F.sum("n").alias("n_points"))
    kept = keep(sample(points, ["x", "y"]))
    shown = sample(_zooms(kept, finest, zooms), ["zoom", "x", "y"])
    return shown.join(counts, ["zoom", "x", "y"]).select(
        "zoom", F.col("x").alias("tile_x"), F.col("y").alias("tile_y"), "n_points", F.col("point_x").alias("x"), F.col("point_y").alias("y"), "time"
    )
