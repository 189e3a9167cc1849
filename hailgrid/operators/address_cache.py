"""Geocoder answers kept between runs.

A store is a Parquet folder with the parsed answers, one folder in it for each load. A load
asks only for the keys that no fresh enough answer is kept of, parses the answers to those,
and adds them; what is kept already is neither parsed nor written again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hailgrid.checkpoints import materialise
from hailgrid.functions.geometry import AREA_TYPE
from hailgrid.operators.geocoding import ADDRESS_TYPE, geocode
from hailgrid.operators.lookup import lookup

STORE_SCHEMA = f"key string, area {AREA_TYPE}, address_info {ADDRESS_TYPE}, answered_at long"


def kept_answers(spark: SparkSession, path: str, now: int, max_age: int | None = None) -> DataFrame:
    """``key, area, address_info, answered_at``: the newest kept answer of each key that is no older than ``max_age``.

    Ages are in the unit of ``now``. Answers from later than ``now`` don't count. A store that isn't there has none.
    """
    try:
        store = spark.read.schema(STORE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        store = spark.createDataFrame([], STORE_SCHEMA)
    fresh = F.col("answered_at") <= now
    if max_age is not None:
        fresh = fresh & (F.col("answered_at") >= now - max_age)
    newest = store.where(fresh).groupBy("key").agg(F.max(F.struct("answered_at", "area", "address_info")).alias("last"))
    return newest.select("key", "last.area", "last.address_info", "last.answered_at")


def unanswered(keys: DataFrame, kept: DataFrame) -> DataFrame:
    """The distinct keys that have no kept answer; a null key asks for nothing."""
    return keys.where("key is not null").distinct().join(kept.select("key"), "key", "left_anti")


def remember(responses: DataFrame, keys: DataFrame, path: str, now: int) -> tuple[DataFrame, int]:
    """Parses the answers to ``keys``, adds them to the store and gives them, with their number."""
    wanted = responses.join(keys, "key", "left_semi").groupBy("key").agg(F.max("body").alias("body"))
    answers, n_answers = materialise(geocode(wanted).select("key", "area", "address_info", F.lit(now).cast("long").alias("answered_at")))
    if n_answers:
        # A failed write leaves the store as it was: what isn't committed isn't read.
        answers.write.mode("append").parquet(path)
    return answers, n_answers


def geocode_with_store(
    requests: DataFrame,
    responses: DataFrame,
    path: str,
    now: int,
    max_age: int | None = None,
    start: str = "start_address",
    dest: str = "dest_address",
    **limits,
) -> tuple[DataFrame, dict[str, int]]:
    """``geocoding.geocode_requests`` by way of a store: the rows, and how many keys were asked, kept and parsed.

    Adds ``start_area, start_address_info, start_age`` and the same for the destination; the age is that of the
    answer when it was used. ``responses`` is asked for unanswered keys only, so it may be a table that is
    fetched for just these.
    """
    spark = requests.sparkSession
    keys = requests.select(F.col(start).alias("key")).union(requests.select(F.col(dest).alias("key")))
    asked, n_asked = materialise(keys.where("key is not null").distinct())
    kept, n_kept = materialise(kept_answers(spark, path, now, max_age).join(asked, "key", "left_semi"))
    new, n_new = remember(responses, unanswered(asked, kept), path, now)
    answers = kept.unionByName(new.select(*kept.columns))
    out = requests
    for key, role in ((start, "start"), (dest, "dest")):
        table = answers.select(
            F.col("key").alias(key),
            F.col("area").alias(f"{role}_area"),
            F.col("address_info").alias(f"{role}_address_info"),
            (F.lit(now) - F.col("answered_at")).alias(f"{role}_age"),
        )
        out = lookup(out, table, [key], n_kept + n_new, counted=requests, **limits)
    return out, {"asked": n_asked, "kept": n_kept, "parsed": n_new}
