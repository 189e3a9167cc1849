"""Statistics that users add: a registry of partial, merge and finish steps.

The fixed statistics of ``functions.statistics`` are chosen per field by the schema. Here any
column may have any registered statistic, each in the same three steps:

* ``partial`` aggregates rows into mergeable columns,
* ``merge`` aggregates such columns again, any number of times and in any order,
* ``finish`` projects them to the result.

Sketches are Spark's own aggregates, so they are combined before the shuffle and their
states stay small whatever the number of rows. ``register`` adds a kind of one's own.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Statistic(Protocol):
    """The three steps for a column; ``name`` begins the names of all columns made for it."""

    def partial(self, name: str, value: Column) -> list[Column]: ...

    def merge(self, name: str) -> list[Column]: ...

    def finish(self, name: str) -> list[Column]: ...


@dataclass(frozen=True)
class Extremes:
    """Least and greatest value, total and mean; a NaN counts for the total and the mean only."""

    def partial(self, name: str, value: Column) -> list[Column]:
        number = value.cast("double")
        plain = F.when(~F.isnan(number), number)
        return [F.min(plain).alias(f"{name}_min"), F.max(plain).alias(f"{name}_max"), F.sum(number).alias(f"{name}_total"), F.count(number).alias(f"{name}_n")]

    def merge(self, name: str) -> list[Column]:
        return [step(f"{name}_{part}").alias(f"{name}_{part}") for part, step in (("min", F.min), ("max", F.max), ("total", F.sum), ("n", F.sum))]

    def finish(self, name: str) -> list[Column]:
        return [F.col(f"{name}_{part}") for part in ("min", "max", "total")] + [F.try_divide(f"{name}_total", f"{name}_n").alias(f"{name}_avg")]


@dataclass(frozen=True)
class Spread:
    """Mean and sample variance, merged by their sums around a fixed ``origin`` (near the values, for accuracy)."""

    origin: float = 0.0

    def partial(self, name: str, value: Column) -> list[Column]:
        off = value.cast("double") - self.origin
        return [F.count(off).alias(f"{name}_n"), F.sum(off).alias(f"{name}_s1"), F.sum(off * off).alias(f"{name}_s2")]

    def merge(self, name: str) -> list[Column]:
        return [F.sum(f"{name}_{part}").alias(f"{name}_{part}") for part in ("n", "s1", "s2")]

    def finish(self, name: str) -> list[Column]:
        n, s1, s2 = (F.col(f"{name}_{part}") for part in ("n", "s1", "s2"))
        variance = F.try_divide(s2 - F.try_divide(s1 * s1, n), n - 1)
        return [(F.try_divide(s1, n) + self.origin).alias(f"{name}_mean"), F.greatest(variance, F.lit(0.0)).alias(f"{name}_variance")]


@dataclass(frozen=True)
class Quantiles:
    """Values at given shares, from a KLL sketch.

    With the default ``k`` the rank of a value is off by 1.33 % of the rows at most, with a
    confidence of 99 %. NULL and NaN don't count.
    """

    shares: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95)
    k: int = 200

    def partial(self, name: str, value: Column) -> list[Column]:
        number = value.cast("double")
        return [F.kll_sketch_agg_double(F.when(~F.isnan(number), number), F.lit(self.k)).alias(f"{name}_kll")]

    def merge(self, name: str) -> list[Column]:
        return [F.kll_merge_agg_double(F.col(f"{name}_kll"), F.lit(self.k)).alias(f"{name}_kll")]

    def finish(self, name: str) -> list[Column]:
        sketch = F.col(f"{name}_kll")
        some = F.kll_sketch_get_n_double(sketch) > 0
        return [F.when(some, F.kll_sketch_get_quantile_double(sketch, F.lit(share))).alias(f"{name}_q{round(100 * share)}") for share in self.shares]


@dataclass(frozen=True)
class Distinct:
    """Number of different values, from a HyperLogLog sketch.

    With the default ``lg_k`` the relative error is 1.6 % (one standard deviation). NULL doesn't count.
    """

    lg_k: int = 12

    def partial(self, name: str, value: Column) -> list[Column]:
        return [F.hll_sketch_agg(value.cast("string"), self.lg_k).alias(f"{name}_hll")]

    def merge(self, name: str) -> list[Column]:
        return [F.hll_union_agg(f"{name}_hll").alias(f"{name}_hll")]

    def finish(self, name: str) -> list[Column]:
        return [F.hll_sketch_estimate(f"{name}_hll").alias(f"{name}_distinct")]


REGISTRY: dict[str, Statistic] = {}


def register(kind: str, statistic: Statistic) -> None:
    """Adds a kind of statistic, or replaces it."""
    if not kind.isidentifier():
        raise ValueError(f"the kind {kind!r} isn't a name")
    REGISTRY[kind] = statistic


for _kind, _statistic in (("extremes", Extremes()), ("spread", Spread()), ("quantiles", Quantiles()), ("distinct", Distinct())):
    register(_kind, _statistic)

Chosen = Mapping[str, Iterable[str]]


def _steps(chosen: Chosen) -> list[tuple[str, str, Statistic]]:
    out = []
    for column, kinds in chosen.items():
        for kind in kinds:
            if kind not in REGISTRY:
                raise ValueError(f"unknown statistic {kind!r}; one of {sorted(REGISTRY)}")
            out.append((column, f"{column}_{kind}", REGISTRY[kind]))
    return out


def partial(chosen: Chosen) -> list[Column]:
    """Aggregates over rows: ``n`` and the states of ``{column: kinds}``."""
    return [F.count(F.lit(1)).alias("n"), *[c for column, name, s in _steps(chosen) for c in s.partial(name, F.col(column))]]


def merge(chosen: Chosen) -> list[Column]:
    """Aggregates over states."""
    return [F.sum("n").alias("n"), *[c for _, name, s in _steps(chosen) for c in s.merge(name)]]


def finish(chosen: Chosen) -> list[Column]:
    """Result columns from states, named ``<column>_<kind>_...``."""
    return [F.col("n"), *[c for _, name, s in _steps(chosen) for c in s.finish(name)]]


def custom_stats(rows: DataFrame, chosen: Chosen, by: Iterable[str] = ()) -> DataFrame:
    """The chosen statistics of all rows, or of each group."""
    by = list(by)
    return rows.groupBy(*by).agg(*partial(chosen)).select(*by, *finish(chosen))
