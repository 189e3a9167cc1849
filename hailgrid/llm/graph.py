"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailgrid.checkpoints import keep
from hailgrid.llm.storage import release


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id that can be reached.

    Each round links the larger neighbours, then the smaller ones, to the least
    neighbour, until nothing changes; rounds grow with the logarithm of the size.
    Neighbour minima are combined before the shuffle and the joins are plain, so
    that adaptive execution can split a hub. No links give no rows.
    """
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = keep(
            small.select("v", "m").union(least.select("u", "m")).toDF("u", "v").where("u <> v").distinct()
        )
        # The shuffle files of a round are of no use to the next one.
        release(edges.sparkSession)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots).groupBy("id").agg(F.min("component").alias("component"))
