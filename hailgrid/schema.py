"""The trip schema: one row per field, in field order.

Field order matters twice: it is the column order of every layer, and it is the
priority in which a CSV header is matched (see ``sources.headers``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Histogram:
    """Integer histogram over the closed bin range ``first..last``."""

    first: int
    last: int

    @property
    def bins(self) -> range:
        return range(self.first, self.last + 1)


@dataclass(frozen=True)
class Summary:
    """Minimum, maximum, total and average."""


@dataclass(frozen=True)
class Field:
    name: str
    type: T.DataType
    variants: tuple[str, ...] = ()
    required: bool = False
    nullable: bool = False
    stat: Histogram | Summary | None = None


POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

_INT, _LONG, _DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()
_BOOL, _TIME = T.BooleanType(), T.TimestampType()

# Field names, order, header variants, required and nullable
# flags, histogram bins.
FIELDS: tuple[Field, ...] = (
    Field("vendor_id", _INT, ("vendor",), stat=Histogram(0, 2)),
    Field("pickup_datetime", _TIME, ("pickupdatetime",), required=True),
    Field("dropoff_datetime", _TIME, ("dropoffdatetime",), required=True),
    Field("passenger_count", _INT, ("passengercount",), stat=Summary()),
    Field("trip_distance", _DOUBLE, ("tripdistance",), stat=Summary()),
    Field("pickup_longitude", _DOUBLE, ("pickuplongitude", "startlon"), required=True),
    Field("pickup_latitude", _DOUBLE, ("pickuplatitude", "startlat"), required=True),
    Field("pickup_location", POINT),
    Field("store_and_fwd_flag", _BOOL, ("storeandfwdflag", "storeandforward")),
    Field("rate_code_id", _INT, ("ratecode",), stat=Histogram(1, 6)),
    Field("dropoff_longitude", _DOUBLE, ("dropofflongitude", "endlon"), required=True),
    Field("dropoff_latitude", _DOUBLE, ("dropofflatitude", "endlat"), required=True),
    Field("dropoff_location", POINT),
    Field("payment_type", _INT, ("paymenttype",), stat=Histogram(0, 6)),
    Field("fare_amount", _DOUBLE, ("fare",), stat=Summary()),
    Field("extra", _DOUBLE, ("extra",)),
    Field("mta_tax", _DOUBLE, ("mtatax",)),
    Field("improvement_surcharge", _DOUBLE, ("surcharge",)),
    Field("tip_amount", _DOUBLE, ("tip",), stat=Summary()),
    Field("tolls_amount", _DOUBLE, ("tolls",), stat=Summary()),
    Field("total_amount", _DOUBLE, ("total",), stat=Summary()),
    Field("trip_type", _INT, ("triptype",), nullable=True),
    Field("ehail_fee", _DOUBLE, ("ehailfee",), nullable=True),
    Field("time_of_day_sec", _LONG),
    Field("cab_type", _INT, stat=Histogram(0, 2)),
)

BY_NAME = {f.name: f for f in FIELDS}

# The two point fields are derived, so staged trips do not carry them.
LOCATION_FIELDS = ("pickup_location", "dropoff_location")
STAGED_FIELDS = tuple(f for f in FIELDS if f.name not in LOCATION_FIELDS)
REQUIRED_FIELDS = tuple(f.name for f in FIELDS if f.required)
STAGED_SCHEMA = T.StructType([T.StructField(f.name, f.type) for f in STAGED_FIELDS])

# Fixed value: the fields summarised when a request asks for the full statistics.
DEFAULT_STAT_FIELDS = (
    "passenger_count",
    "trip_distance",
    "fare_amount",
    "tip_amount",
    "tolls_amount",
    "total_amount",
    "vendor_id",
    "rate_code_id",
    "payment_type",
    "cab_type",
)
