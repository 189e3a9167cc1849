import math
import random

import pytest
from pyspark.sql import functions as F

import hailgrid as hg
from hailgrid.functions import pluggable


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    values = [(i % 7, rng.expovariate(0.1), rng.randrange(5000), None if i % 11 else "x%d" % (i % 300)) for i in range(20_000)]
    return spark.createDataFrame(values + [(1, math.nan, None, None)], "g int, v double, k int, s string").repartition(6)


CHOSEN = {"v": ["extremes", "spread", "quantiles"], "k": ["distinct", "quantiles"], "s": ["distinct"]}


def test_merged_from_parts_within_the_stated_error(rows):
    parts = rows.groupBy("g", F.spark_partition_id().alias("p")).agg(*pluggable.partial(CHOSEN))
    merged = parts.groupBy("g").agg(*pluggable.merge(CHOSEN)).agg(*pluggable.merge(CHOSEN)).select(*pluggable.finish(CHOSEN)).first()
    data = rows.collect()
    v = sorted(r.v for r in data if not math.isnan(r.v))
    assert merged.n == len(data)
    assert (merged.v_extremes_min, merged.v_extremes_max) == (v[0], v[-1]) and math.isnan(merged.v_extremes_total)
    for share in (25, 50, 75, 95):
        assert abs(sum(x <= merged[f"v_quantiles_q{share}"] for x in v) / len(v) - share / 100) <= 0.0133
    k = {r.k for r in data if r.k is not None}
    assert abs(merged.k_distinct_distinct - len(k)) <= 0.05 * len(k)
    s = {r.s for r in data if r.s is not None}
    assert abs(merged.s_distinct_distinct - len(s)) <= 0.05 * len(s)


def test_spread_equals_the_built_in(rows):
    plain = rows.where("not isnan(v)")
    got = hg.custom_stats(plain, {"v": ["spread"]}).first()
    mean, variance = plain.agg(F.avg("v"), F.var_samp("v")).first()
    assert got.v_spread_mean == pytest.approx(mean) and got.v_spread_variance == pytest.approx(variance)


def test_no_values(spark):
    none = spark.createDataFrame([(None, None, None)], "v double, k int, s string")
    row = hg.custom_stats(none, CHOSEN).first()
    assert (row.n, row.v_extremes_avg, row.v_spread_mean, row.v_quantiles_q50, row.k_distinct_distinct) == (1, None, None, None, 0)
    assert hg.custom_stats(none.limit(0), {"v": ["extremes"]}).first().n == 0


def test_a_kind_of_ones_own(rows, monkeypatch):
    class Longest:
        def partial(self, name, value):
            return [F.max(F.length(value.cast("string"))).alias(f"{name}_most")]

        def merge(self, name):
            return [F.max(f"{name}_most").alias(f"{name}_most")]

        def finish(self, name):
            return [F.col(f"{name}_most")]

    monkeypatch.setattr(pluggable, "REGISTRY", dict(pluggable.REGISTRY))
    pluggable.register("longest", Longest())
    assert hg.custom_stats(rows, {"s": ["longest"]}).first().s_longest_most == 4
    assert {r.g for r in hg.custom_stats(rows, {"s": ["longest"]}, by=["g"]).collect()} == set(range(7))
    with pytest.raises(ValueError, match="unknown statistic"):
        hg.custom_stats(rows, {"s": ["shortest"]})
    with pytest.raises(ValueError):
        pluggable.register("not a name", Longest())
