"""Approximate nearest neighbours by shifted Hilbert curves.

Each curve projects the vectors to a few random directions, shifts them and orders them
along a Hilbert curve. Spark range-partitions the keys; a query's candidates are its
neighbours within a window of ranks on each curve. Windows are cut into blocks of ranks, so
a task holds one block of vectors and the queries whose windows reach it. The nearest of
each block are merged and ranked anew by exact cosine.

Equal vectors are one point of the curve: copies share a key, and any number of them adds
no more than the ids that can be among the results.

How wide windows must be depends on the data. Clustered vectors keep their neighbours
close on a curve; independent random ones in many dimensions hardly do, so the window is
a share of all rows by default. ``README.md`` has recall figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailgrid.checkpoints import keep

BITS = 16
# Queries that meet a block in one task.
QUERIES_A_TASK = 20_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (rows x axes), axes * bits below 63."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(axes):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(-1, size)


def _scaled(keys: list[bytes], size: int) -> np.ndarray:
    """Vectors times a power of two, which changes no cosine, so that their squares neither overflow nor vanish."""
    vectors = np.frombuffer(b"".join(keys), np.float64).reshape(-1, size)
    _, exponents = np.frexp(np.abs(vectors).max(1, initial=0))
    return np.ldexp(vectors, -exponents[:, None])


def _distinct(size: int, most: int, every: int):
    """Rows (vector, key, ids, asked) of a batch's distinct vectors: the least ids of each, and whether one is a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = batch.column("vec_id").to_numpy(), _matrix(batch.column("vector"), size) + 0.0
            unique, which = np.unique(vectors, axis=0, return_inverse=True)
            which = which.ravel()
            order = np.lexsort((ids, which))
            starts = np.searchsorted(which[order], np.arange(len(unique) + 1))
            own = [np.unique(ids[order[a:b]])[:most] for a, b in zip(starts[:-1], starts[1:], strict=True)]
            asked = np.bincount(which, ids % every == 0) > 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([v.tobytes() for v in unique], pa.binary()),
                    pa.ListArray.from_arrays(np.cumsum([0, *map(len, own)]).astype(np.int32), pa.array(np.concatenate(own))),
                    pa.array(asked),
                ],
                ["key", "ids", "asked"],
            )

    return run


def _on_curves(size: int, curves: int, axes: int, seed: int):
    """Rows (curve, place, uid, key, ids, asked): each vector's place on each curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(seed)
        directions = random.normal(size=(curves, size, axes))
        shifts = random.random((curves, axes))
        for batch in batches:
            vectors = _scaled(batch.column("key").to_pylist(), size)
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            for c in range(curves):
                # Spread evenly over the cells, then shifted by less than one breadth.
                even = 0.5 + 0.5 * np.tanh(0.8 * (unit @ directions[c]))
                cells = ((even + shifts[c]) / 2 * (1 << BITS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(unit), c, np.int32)), pa.array(hilbert_keys(np.minimum(cells, (1 << BITS) - 1), BITS)), *(batch.column(n) for n in ("uid", "key", "ids", "asked"))],
                    ["curve", "place", "uid", "key", "ids", "asked"],
                )

    return run


def _ranked(offsets: dict[tuple[int, int], int]):
    """Each row's rank on its curve, from the counts of the partitions before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            curves = batch.column("curve").to_numpy()
            ranks = np.empty(len(curves), np.int64)
            for c in np.unique(curves).tolist():
                own = curves == c
                ranks[own] = offsets[part, c] + seen.get(c, 0) + np.arange(own.sum())
                seen[c] = seen.get(c, 0) + int(own.sum())
            yield pa.RecordBatch.from_arrays([pa.array(ranks), *(batch.column(n) for n in ("curve", "uid", "key", "ids", "asked"))], ["rank", "curve", "uid", "key", "ids", "asked"])

    return run


def _nearest(size: int, most: int):
    """Per query of a block: its ``most`` nearest (score, id) among the block's rows in its window."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found = {"query": [], "near": []}
        if rows.num_rows and queries.num_rows:
            a, b = (_scaled(t.column("key").to_pylist(), size) for t in (rows, queries))
            length_a, length_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
            ranks, ids = rows.column("rank").to_numpy(), rows.column("ids").to_pylist()
            low, high = queries.column("low").to_numpy(), queries.column("high").to_numpy()
            take = min(most, len(a))
            for begin in range(0, len(b), 512):
                q = slice(begin, begin + 512)
                scores = (b[q] / length_b[q, None]) @ (a / length_a[:, None]).T
                scores[(ranks < low[q, None]) | (ranks > high[q, None])] = -np.inf
                best = np.argpartition(-scores, take - 1, axis=1)[:, :take]
                for i, own in enumerate(best):
                    own = own[scores[i, own] > -np.inf]
                    # Cosines of the chosen ones, each computed alone so that it doesn't depend on the block.
                    exact = (a[own] * b[begin + i]).sum(1) / (length_a[own] * length_b[begin + i])
                    near = sorted((-s, v) for s, j in zip(exact.tolist(), own.tolist(), strict=True) for v in ids[j])[:most]
                    found["query"].append(queries.column("uid")[begin + i].as_py())
                    found["near"].append([{"score": -s, "vec_id": v} for s, v in near])
        return pa.Table.from_pydict(
            found, schema=pa.schema([("query", pa.int64()), ("near", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))])
        )

    return run


def neighbours(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    every: int = 50,
    curves: int = 8,
    axes: int = 2,
    window_share: float = 0.25,
    least_window: int = 1024,
    block_rows: int = 4096,
    seed: int = 7,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose id is divisible by ``every``.

    Nearness is cosine in double precision, ties go to the smaller id, and a query's own
    id is no candidate. Each curve's window reaches ``window_share`` of the distinct
    vectors, at least ``least_window``, half to each side. Rows with null id take no part,
    nor do vectors that are null, zero, of another length than most, or hold null or
    non-finite numbers. A repeated row counts once. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    numbers = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), numbers.alias("vector")).where("vec_id is not null and vector is not null")
    infinite = F.lit(float("inf"))
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], empty)
    size, most = sizes[0]["size"], k + 1
    rows = rows.where(F.size("vector") == size)
    points = keep(
        rows.mapInArrow(_distinct(size, most, every), "key binary, ids array<long>, asked boolean")
        .groupBy("key")
        .agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"), F.max("asked").alias("asked"))
        .withColumn("uid", F.monotonically_increasing_id())
    )
    count = points.count()
    half = max(least_window, int(count * window_share)) // 2

    placed = points.mapInArrow(_on_curves(size, curves, axes, seed), "curve int, place long, uid long, key binary, ids array<long>, asked boolean")
    parts = max(curves, -(-count * curves // (4 * block_rows)))
    ordered = keep(placed.repartitionByRange(parts, "curve", "place", "uid").sortWithinPartitions("curve", "place", "uid"))
    # One number for each partition and curve in it.
    counts = ordered.groupBy(F.spark_partition_id().alias("part"), "curve").count().orderBy("part").collect()
    offsets, before = {}, [0] * curves
    for r in counts:
        offsets[r["part"], r["curve"]] = before[r["curve"]]
        before[r["curve"]] += r["count"]
    ranked = ordered.mapInArrow(_ranked(offsets), "rank long, curve int, uid long, key binary, ids array<long>, asked boolean")

    # Blocks that very many queries reach are repeated, each with a share of the queries.
    reach = (2 * half + block_rows) // every + 1
    shares = max(1, -(-reach // QUERIES_A_TASK))
    blocks = ranked.select("curve", F.floor(F.col("rank") / block_rows).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "rank", "key", "ids")
    low, high = F.greatest(F.col("rank") - half, F.lit(0)), F.least(F.col("rank") + half, F.lit(count - 1))
    asked = ranked.where("asked").select(
        "curve",
        F.explode(F.sequence(F.floor(low / block_rows), F.floor(high / block_rows))).alias("block"),
        F.pmod(F.xxhash64("uid"), F.lit(shares)).cast("int").alias("share"),
        "uid",
        "key",
        low.alias("low"),
        high.alias("high"),
    )
    group = ["curve", "block", "share"]
    near = blocks.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(_nearest(size, most), "query long, near array<struct<score:double,vec_id:long>>")
    merged = near.groupBy("query").agg(
        F.slice(F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list("near")), lambda x: F.struct((-x["score"]).alias("far"), x["vec_id"].alias("vec_id"))))), 1, most).alias("near")
    )
    # The queries of each point: all its rows with a query's id.
    queries = (
        rows.where(F.pmod("vec_id", F.lit(every)) == 0)
        .mapInArrow(_query_keys(size), "query_id long, key binary")
        .distinct()
        .join(points.where("asked").select("uid", "key"), "key")
        .select("query_id", F.col("uid").alias("query"))
    )
    others = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    return (
        queries.join(merged, "query")
        .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "found"))
        .select("query_id", (F.col("place") + 1).alias("rank"), F.col("found.vec_id").alias("vec_id"), (-F.col("found.far")).alias("score"))
    )


def _query_keys(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"), size) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v.tobytes() for v in vectors], pa.binary())], ["query_id", "key"])

    return run
