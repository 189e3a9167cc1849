"""Skew-safe lookups of the request operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailgrid.checkpoints import materialise

# A lookup table is broadcast up to so many rows and so many bytes of its text form.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
# Rows of one key from which its table row is sent to the rows instead, and a bound on such keys.
HOT_ROWS = 1_000_000
HOT_KEYS = 10_000
# Pieces that rows are dealt to where the table's rows of such keys are too large to be sent.
HOT_PIECES = 16


def fits(table: DataFrame, rows: int, most: int) -> bool:
    """Whether a table of so many rows may be broadcast: by its rows, then by its bytes."""
    if rows > most:
        return False
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    table_rows: int,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Left join of ``rows`` with a ``table`` that has one row per key.

    A table of checked size is broadcast. For a larger one the rows of each key are
    counted: keys with very many are few, so their table rows are broadcast, if their bytes
    allow, and those rows stay where they are; only the others are shuffled. Rows with a
    null key match nothing and aren't shuffled either. ``counted`` may be given to be counted
    for ``rows``: rows with the same keys that take less work, as those before another lookup.
    """
    if fits(table, table_rows, broadcast_rows):
        return rows.join(F.broadcast(table), keys, "left")
    # Rows with a null key have no match; they stay where they are.
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    keyed = rows.where(known)
    counts = (keyed if counted is None else counted.where(known)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot, n_hot = materialise(counts.where(F.col("_n") > hot_rows))
    if n_hot > HOT_KEYS:
        # No more keys than this can have more than so large a share of all rows.
        total = counts.agg(F.sum("_n")).first()[0]
        hot, n_hot = materialise(hot.where(F.col("_n") > total // HOT_KEYS))
    hot = hot.select(*keys)
    unknown = rows.where(~known)
    if n_hot:
        hot_table, n_hot = materialise(table.join(F.broadcast(hot), keys, "left_semi"))
        if fits(hot_table, n_hot, HOT_KEYS):
            marked = keyed.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
            many = marked.where("_hot").drop("_hot").join(F.broadcast(hot_table), keys, "left")
            few = marked.where("_hot is null").drop("_hot").join(table, keys, "left")
            return many.unionByName(few).unionByName(unknown, allowMissingColumns=True)
        # Their rows are too large to be sent to all: the table's are repeated, and the others dealt out.
        pieces = F.lit(HOT_PIECES)
        dealt = keyed.withColumn("_piece", F.pmod(F.monotonically_increasing_id(), pieces).cast("int"))
        repeated = table.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        return dealt.join(repeated, [*keys, "_piece"], "left").drop("_piece").unionByName(unknown, allowMissingColumns=True)
    return keyed.join(table, keys, "left").unionByName(unknown, allowMissingColumns=True)
