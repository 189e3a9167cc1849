"""Near-duplicate vectors by an inverted multi-index.

1. Vectors are scaled to unit length and cut in halves. Each half has a codebook of its
   own, fitted on a bounded sample; the pairs of codes are the cells of a product grid,
   which holds every vector.
2. A vector visits cells in the order of multi-sequence traversal: the codes of each half
   are sequences sorted by how far the vector is from a code's region (from the plane
   between that code and its own), and the traversal follows the sums of both squares.
   It stops at a reach that finds the wanted share of links: the larger of what links at the
   threshold and of no special direction need, and what nearly all links of a sample of vectors
   need, which is compared with all others.
3. Vectors meet in tiles: the whole label where it is small, else a row of the grid, else
   a cell, else a share of a cell. Visitors are dealt out likewise, so no task holds more
   than two bounded blocks. Cosines in double precision verify each pair once: the vector
   of the smaller cell visits the larger one.

Pairs never leave a task: per vector go out the number of its links and one root it is
linked with. Equal vectors are one point with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailgrid.checkpoints import keep
from hailgrid.llm.graph import components
from hailgrid.llm.storage import stored

# Numbers of the bounded sample that codebooks are fitted on; most codes of a half.
SAMPLE_NUMBERS = 1 << 20
MOST_CODES = 256
# Vectors of a tile, and visitors that meet it at once (in expectation: both are dealt by hash).
TILE_ROWS = 4096
TILE_VISITORS = 16384
# Vectors that are compared with all others to measure the reach.
PROBES = 256
# The share of the links found for them that the reach must hold.
SAMPLED_RECALL = 0.999
_BINS = 256


def _units(keys: list[bytes], size: int) -> np.ndarray:
    """Unit vectors; first scaled by a power of two, so that squares neither overflow nor vanish."""
    vectors = np.frombuffer(b"".join(keys), np.float64).reshape(-1, size)
    _, exponents = np.frexp(np.abs(vectors).max(1, initial=0))
    vectors = np.ldexp(vectors, -exponents[:, None])
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def _keys(size: int):
    """Bytes of each vector, negative zeros as zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.array(batch.column("vector").flatten(), np.float64) + 0.0
            width = 8 * size
            keys = pa.Array.from_buffers(
                pa.binary(), batch.num_rows, [None, pa.py_buffer(np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(numbers)]
            )
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("row", "vec_id", "label_key")), keys], ["row", "vec_id", "label_key", "key"])

    return run


def _centres(vectors: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """k-means; starts from every so-manieth vector, a code without vectors stays where it is."""
    centres = vectors[np.linspace(0, len(vectors) - 1, codes).astype(int)].copy()
    for _ in range(rounds):
        own = _squares(vectors, centres).argmin(1)
        counts = np.bincount(own, minlength=codes)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        held = counts > 0
        centres[held] = sums[held] / counts[held, None]
    return centres


def _squares(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (vectors * vectors).sum(1)[:, None] - 2 * vectors @ centres.T + (centres * centres).sum(1)


class Grid:
    """Two codebooks, one for each half of the vectors."""

    def __init__(self, sample: np.ndarray, codes: int):
        self.cut = (sample.shape[1] + 1) // 2
        self.codes = max(1, min(codes, len(sample)))
        self.books = [_centres(half, self.codes) for half in self.halves(sample)]
        # Distance between the centres of a book.
        self.apart = [np.sqrt(np.maximum(_squares(book, book), 1e-30)) for book in self.books]

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[:, : self.cut], vectors[:, self.cut :]

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The cell of each vector, and per half its squared distance from the plane to each code's region."""
        own, planes = [], []
        for half, book, apart in zip(self.halves(vectors), self.books, self.apart, strict=True):
            squares = _squares(half, book)
            code = squares.argmin(1)
            plane = np.maximum(squares - squares[np.arange(len(code)), code][:, None], 0) / (2 * apart[code])
            plane[np.arange(len(code)), code] = 0
            own.append(code)
            planes.append(plane * plane)
        return own[0] * self.codes + own[1], planes

    def visits(self, cells: np.ndarray, planes: list[np.ndarray], reach: float) -> list[np.ndarray]:
        """Per vector the cells from its own on that its traversal visits, nearest first."""
        first, second = (np.argsort(p, axis=1, kind="stable") for p in planes)
        near, far = (np.take_along_axis(p, o, 1) for p, o in zip(planes, (first, second), strict=True))
        out = []
        for i in range(len(cells)):
            # The staircase below the reach: a prefix of the second sequence for each code of the first.
            rows = int(np.searchsorted(near[i], reach, side="right"))
            ends = np.searchsorted(far[i], reach - near[i, :rows], side="right")
            row = np.repeat(np.arange(rows), ends)
            column = np.arange(len(row)) - np.repeat(np.cumsum(ends) - ends, ends)
            order = np.argsort(near[i, row] + far[i, column], kind="stable")
            found = first[i, row[order]] * self.codes + second[i, column[order]]
            out.append(found[found >= cells[i]])
        return out


def _placed(size: int, grid: Grid, reach: float):
    """Rows (uid, label, cell, visits) of the points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, planes = grid.place(_units(batch.column("key").to_pylist(), size))
            visits = grid.visits(cells, planes, reach)
            # The visited cells of each vector by their row of the grid.
            vector = np.repeat(np.arange(len(visits)), [len(v) for v in visits])
            visited = np.concatenate(visits)
            order = np.lexsort((visited // grid.codes, vector))
            vector, visited = vector[order], visited[order]
            row = visited // grid.codes
            first = np.flatnonzero(np.append(True, (vector[1:] != vector[:-1]) | (row[1:] != row[:-1])))
            own = pa.ListArray.from_arrays(np.append(first, len(row)).astype(np.int32), pa.array(visited.astype(np.int32)))
            rows = pa.StructArray.from_arrays([pa.array(row[first].astype(np.int32)), own], ["grid_row", "cells"])
            ends = np.searchsorted(vector[first], np.arange(len(visits) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("label_key"), pa.array(cells.astype(np.int32)), pa.ListArray.from_arrays(ends, rows)],
                ["uid", "label_key", "cell", "visits"],
            )

    return run


def _needed_reach(size: int, grid: Grid, probes: list[tuple[int, bytes]], threshold: float, top: float):
    """How many links of the probes need a reach up to each of ``_BINS`` steps of ``top``: (bin, links) of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([label for label, _ in probes])
        asked = _units([key for _, key in probes], size)
        cells, planes = grid.place(asked)
        total = np.zeros(_BINS, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _units(batch.column("key").to_pylist(), size)
            own = np.array(batch.column("label_key"))
            a, b = np.nonzero((asked @ vectors.T >= threshold) & (labels[:, None] == own))
            if not len(a):
                continue
            there, back = grid.place(vectors[b])
            # The one of the smaller cell visits the other's.
            from_probe = cells[a] <= there
            codes = np.where(from_probe, there, cells[a])
            x, y = codes // grid.codes, codes % grid.codes
            k = np.arange(len(a))
            need = np.where(from_probe, planes[0][a, x] + planes[1][a, y], back[0][k, x] + back[1][k, y])
            total += np.bincount(np.minimum((need / top * _BINS).astype(int), _BINS - 1), minlength=_BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_BINS)), pa.array(total)], ["bin", "links"])

    return run


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of 0 .. count - 1 is connected with by the pairs (a, b)."""
    root = np.arange(count)
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        if (root == before).all():
            return root


def _verified(size: int, threshold: float):
    """Rows (uid, links, root) of the points of a tile and its visitors that have links."""

    def run(rows: pa.Table, visitors: pa.Table) -> pa.Table:
        out = pa.schema([("uid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        if not rows.num_rows or not visitors.num_rows:
            return out.empty_table()
        held, comes = (_units(t.column("key").to_pylist(), size) for t in (rows, visitors))
        ids, count, cell = (np.array(rows.column(n)) for n in ("uid", "n", "cell"))
        own_ids, own_count, own_cell = (np.array(visitors.column(n)) for n in ("uid", "n", "cell"))
        column = visitors.column("cells").combine_chunks()
        visited, visitor = np.array(column.flatten()), np.repeat(np.arange(len(own_ids)), np.diff(np.array(column.offsets)))
        by_cell, by_visit = np.argsort(cell, kind="stable"), np.argsort(visited, kind="stable")
        everyone, number = np.unique(np.concatenate([ids, own_ids]), return_inverse=True)
        links = np.zeros(len(everyone), np.int64)
        pairs = [(np.zeros(0, np.int64),) * 2]
        for c in np.intersect1d(cell, visited).tolist():
            there = by_cell[slice(*np.searchsorted(cell[by_cell], [c, c + 1]))]
            here = visitor[by_visit[slice(*np.searchsorted(visited[by_visit], [c, c + 1]))]]
            for begin in range(0, len(here), 256):
                part = here[begin : begin + 256]
                score = comes[part] @ held[there].T
                i, j = np.nonzero(score >= threshold - 1e-9)
                x, y = part[i], there[j]
                # Near the limit each pair alone, so that the order of sums doesn't depend on the block.
                right = (comes[x] * held[y]).sum(1) >= threshold
                right &= (own_cell[x] < c) | (own_ids[x] < ids[y])
                x, y = x[right], y[right]
                a, b = number[len(ids) + x], number[y]
                np.add.at(links, a, count[y])
                np.add.at(links, b, own_count[x])
                if len(a):
                    # What connects them, as no more pairs than points.
                    near = np.unique(np.concatenate([a, b]))
                    root = _roots(len(near), np.searchsorted(near, a), np.searchsorted(near, b))
                    pairs.append((near, near[root]))
        root = _roots(len(everyone), *map(np.concatenate, zip(*pairs, strict=True)))
        some = np.flatnonzero(links > 0)
        return pa.table([pa.array(everyone[some]), pa.array(links[some]), pa.array(everyone[root[some]])], schema=out)

    return run


def _one_length(points: DataFrame, size: int, threshold: float, recall: float, codes: int | None) -> DataFrame:
    """(uid, links, root) of the points of one length that are linked in some tile."""
    spark = points.sparkSession
    count = points.count()
    sample_rows = max(256, min(8192, SAMPLE_NUMBERS // size))
    by_hash = points.orderBy(F.xxhash64("key"), "uid")
    sample = by_hash.limit(sample_rows).select("key").collect()
    codes = codes or max(1, min(MOST_CODES, round(math.sqrt(count / 32))))
    grid = Grid(_units([bytes(r.key) for r in sample], size), codes)

    # The squared distance of linked unit vectors; of one without direction each axis takes its share.
    square = 2 * (1 - threshold)
    modelled = square / size * -2 * math.log(max(1 - recall, 1e-12))
    probes = [(r.label_key, bytes(r.key)) for r in by_hash.limit(PROBES).select("label_key", "key").collect()]
    steps = (
        points.select("label_key", "key")
        .mapInArrow(_needed_reach(size, grid, probes, threshold, square), "bin long, links long")
        .groupBy("bin")
        .agg(F.sum("links").alias("links"))
        .orderBy("bin")
        .collect()
    )
    found = np.array([r["links"] for r in steps] or [0])
    share = np.cumsum(found) / max(1, found.sum())
    measured = (int(np.searchsorted(share, SAMPLED_RECALL)) + 1) * square / _BINS
    # Beyond the whole distance there is nothing to be found.
    reach = min(max(modelled, measured), square)

    placed = stored(points.mapInArrow(_placed(size, grid, reach), "uid long, label_key long, cell int, visits array<struct<grid_row:int,cells:array<int>>>"))
    row = F.floor(F.col("cell") / grid.codes).cast("int").alias("grid_row")
    in_cell = placed.groupBy("label_key", row, "cell").agg(F.count(F.lit(1)).alias("in_cell"))
    in_row = in_cell.groupBy("label_key", "grid_row").agg(F.sum("in_cell").alias("in_row"))
    in_label = in_row.groupBy("label_key").agg(F.sum("in_row").alias("in_label"))
    # The tile of a grid's row where it is small, or the label is; full rows are cut into cells, full cells into shares.
    small = F.when(F.col("in_label") <= TILE_ROWS, F.lit(-1)).when(F.col("in_row") <= TILE_ROWS, -2 - F.col("grid_row"))
    rows = keep(in_row.join(in_label, "label_key").select("label_key", "grid_row", small.alias("tile")))
    shares = F.ceil(F.col("in_cell") / TILE_ROWS).cast("int").alias("shares")
    cut = keep(in_cell.join(rows.where("tile is null").drop("tile"), ["label_key", "grid_row"]).select("label_key", "cell", shares))
    held = placed.select("uid", "label_key", "cell", row).join(rows, ["label_key", "grid_row"]).drop("grid_row").join(cut, ["label_key", "cell"], "left")
    held = held.withColumn("share", F.pmod(F.xxhash64("uid"), F.coalesce("shares", F.lit(1))).cast("int")).withColumn("tile", F.coalesce("tile", "cell"))
    visits = placed.select("uid", "label_key", F.col("cell").alias("own"), F.inline("visits")).join(rows, ["label_key", "grid_row"])
    whole = visits.where("tile is not null").select("uid", "label_key", "own", "tile", F.lit(1).alias("shares"), "cells")
    single = visits.where("tile is null").select("uid", "label_key", "own", F.explode("cells").alias("cell")).join(cut, ["label_key", "cell"])
    single = single.select("uid", "label_key", "own", F.col("cell").alias("tile"), "shares", F.array("cell").alias("cells"))
    coming = whole.unionByName(single).groupBy("uid", "label_key", "own", "tile", "shares").agg(F.flatten(F.collect_list("cells")).alias("cells"))
    crowds = coming.groupBy("label_key", "tile").agg(F.ceil(F.count(F.lit(1)) / TILE_VISITORS).cast("int").alias("crowds"))
    crowds = keep(crowds)
    group = ["label_key", "tile", "share", "crowd"]
    held = held.join(crowds, ["label_key", "tile"]).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)))
    coming = coming.join(crowds, ["label_key", "tile"]).withColumn("crowd", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("crowds")).cast("int"))
    coming = coming.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    vectors = points.select("uid", "key", "n")
    held = held.select(*group, "uid", "cell").join(vectors, "uid")
    visitors = coming.select(*group, "uid", F.col("own").alias("cell"), "cells").join(vectors, "uid")
    # Columns of their own, as both sides come from the same points.
    held, visitors = held.toDF(*held.columns), visitors.toDF(*visitors.columns)
    return held.groupBy(*group).cogroup(visitors.groupBy(*group)).applyInArrow(_verified(size, threshold), "uid long, links long, root long")


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    recall: float = 0.97,
    codes: int | None = None,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vectors``.

    Two rows are linked if their labels are equal and not null and the cosine of their
    vectors, in double precision, is ``threshold`` or more. ``n_links`` counts the other
    rows linked with a row, ``component_id`` is the least id that links reach, its own
    included, and ``kept`` marks the rows with that id. ``recall`` is the share of links just
    at the threshold that the traversal is to visit, closer ones are visited more often; what it
    visits is verified, so no link is wrong.

    Vectors that are null, empty, zero or hold null or non-finite numbers have no links, nor
    have rows without label; vectors are linked with others of their length only (each length
    has an index of its own). A repeated row is a vector of its own. A null id takes part and is a
    component's id only where no row has one. Extra columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = stored(
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")).withColumn(
            "row", F.monotonically_increasing_id()
        )
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where("label is not null and vector is not null").where(finite & F.exists("vector", lambda x: x != 0))
    usable = usable.withColumn("size", F.size("vector"))
    linked = None
    for size in sorted(r["size"] for r in usable.select("size").distinct().collect()):
        own = usable.where(F.col("size") == size)
        # A label's 64-bit hash stands for it, so that labels may be of any type.
        members = own.select("row", "vec_id", F.xxhash64("label").alias("label_key"), "vector").mapInArrow(_keys(size), "row long, vec_id long, label_key long, key binary")
        points = stored(
            members.groupBy("label_key", "key")
            .agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id"))
            .withColumn("uid", F.monotonically_increasing_id())
        )
        found = stored(_one_length(points, size, threshold, recall, codes))
        links = found.groupBy("uid").agg(F.sum("links").alias("links"))
        of = keep(components(found.select(F.col("uid").alias("a"), F.col("root").alias("b"))))
        known = points.select("uid", "label_key", "key", "n", "least_id").join(links, "uid", "left").join(of.withColumnRenamed("id", "uid"), "uid", "left")
        known = known.withColumn("component", F.coalesce("component", "uid"))
        least = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
        known = known.join(least, "component").select("label_key", "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
        part = members.join(known, ["label_key", "key"]).select("row", "n_links", "component_id")
        linked = part if linked is None else linked.unionByName(part)
    if linked is None:
        linked = spark.createDataFrame([], "row long, n_links long, component_id long")
    return (
        rows.select("row", "vec_id")
        .join(linked.withColumn("found", F.lit(True)), "row", "left")
        .withColumn("component_id", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id")))
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
