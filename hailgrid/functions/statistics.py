"""Trip statistics as lists of built-in aggregates.

Statistics go through three steps, so they can be computed in one pass or
merged from partial results:

* ``partial(fields)`` aggregates trips into mergeable columns,
* ``merge(fields)`` aggregates such columns again,
* ``finish(fields)`` projects them to the result columns.

Result columns are flat: ``count``, ``<field>_min/_max/_total/_avg`` for a
summary, ``<field>_<bin>`` for a histogram and ``duration_*``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hailgrid.schema import BY_NAME, DEFAULT_STAT_FIELDS, FIELDS, Histogram

DURATION = "duration"


def duration_seconds(pickup: str | Column = "pickup_datetime", dropoff: str | Column = "dropoff_datetime") -> Column:
    """Whole seconds from pickup to drop-off; may be negative."""
    return F.unix_seconds(dropoff) - F.unix_seconds(pickup)


def stat_fields(fields: Iterable[str] | None = None) -> list[str]:
    """Chosen fields that have a statistic, in field order.

    ``None`` stands for the full default set; an empty list leaves count and
    duration only. Fields without a statistic are ignored.
    """
    chosen = set(DEFAULT_STAT_FIELDS if fields is None else fields)
    unknown = chosen - BY_NAME.keys()
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    return [f.name for f in FIELDS if f.name in chosen and f.stat is not None]


def _summary_partial(name: str, value: Column) -> list[Column]:
    number = F.when(~F.isnan(value.cast("double")), value)
    return [
        F.min(number).alias(f"{name}_min"),
        F.max(number).alias(f"{name}_max"),
        F.sum(value).alias(f"{name}_total"),
        F.count(value).alias(f"{name}_n"),
    ]


def partial(fields: Iterable[str] | None = None, duration: Column | None = None) -> list[Column]:
    """Aggregates over trips. ``duration`` replaces the pickup/drop-off difference."""
    out = [F.count(F.lit(1)).alias("count")]
    for name in stat_fields(fields):
        stat = BY_NAME[name].stat
        if isinstance(stat, Histogram):
            out += [F.count_if(F.col(name) == b).alias(f"{name}_{b}") for b in stat.bins]
        else:
            out += _summary_partial(name, F.col(name))
    return out + _summary_partial(DURATION, duration_seconds() if duration is None else duration)


def merge(fields: Iterable[str] | None = None) -> list[Column]:
    """Aggregates over partial statistics."""
    out = [F.sum("count").alias("count")]
    for name in stat_fields(fields):
        stat = BY_NAME[name].stat
        if isinstance(stat, Histogram):
            out += [F.sum(f"{name}_{b}").alias(f"{name}_{b}") for b in stat.bins]
        else:
            out += _summary_merge(name)
    return out + _summary_merge(DURATION)


def _summary_merge(name: str) -> list[Column]:
    return [
        F.min(f"{name}_min").alias(f"{name}_min"),
        F.max(f"{name}_max").alias(f"{name}_max"),
        F.sum(f"{name}_total").alias(f"{name}_total"),
        F.sum(f"{name}_n").alias(f"{name}_n"),
    ]


def finish(fields: Iterable[str] | None = None) -> list[Column]:
    """Result columns from partial statistics; no value gives NULL."""
    out = [F.col("count")]
    for name in stat_fields(fields):
        stat = BY_NAME[name].stat
        if isinstance(stat, Histogram):
            out += [F.col(f"{name}_{b}") for b in stat.bins]
        else:
            out += _summary_finish(name)
    return out + _summary_finish(DURATION)


def _summary_finish(name: str) -> list[Column]:
    total = F.col(f"{name}_total").cast("double")
    return [
        F.col(f"{name}_min").cast("double").alias(f"{name}_min"),
        F.col(f"{name}_max").cast("double").alias(f"{name}_max"),
        total.alias(f"{name}_total"),
        F.try_divide(total, F.col(f"{name}_n").cast("double")).alias(f"{name}_avg"),
    ]


def trip_stats(trips: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """One row of statistics over all ``trips``."""
    chosen = stat_fields(fields)
    return trips.agg(*partial(chosen)).select(*finish(chosen))


def stats_struct(fields: Iterable[str] | None = None, scale: int | None = None) -> Column:
    """Result columns packed as ``count``, one entry per field, ``duration``.

    A summary becomes a struct of ``min, max, total, avg``, a histogram a struct
    of bins. ``scale`` writes the numbers as decimals with that many places.
    """

    def number(column: str) -> Column:
        return F.col(column) if scale is None else F.col(column).cast(f"decimal(38,{scale})")

    def summary(name: str) -> Column:
        return F.struct(*[number(f"{name}_{k}").alias(k) for k in ("min", "max", "total", "avg")])

    entries = [F.col("count").alias("count")]
    for name in stat_fields(fields):
        stat = BY_NAME[name].stat
        if isinstance(stat, Histogram):
            packed = F.struct(*[F.col(f"{name}_{b}").alias(str(b)) for b in stat.bins])
        else:
            packed = summary(name)
        entries.append(packed.alias(name))
    return F.struct(*entries, summary(DURATION).alias(DURATION))


def stats_json(stats: DataFrame, fields: Iterable[str] | None = None, scale: int | None = None) -> DataFrame:
    """Statistics rows as JSON text in a column ``stats``."""
    return stats.select(F.to_json(stats_struct(fields, scale)).alias("stats"))
