"""Exact repeated passages: bytes covered by a string of ``length`` bytes that also starts elsewhere.

Prefix doubling. The rank of a position at length h stands for its next h bytes; the
rank at 2h comes from the pair of ranks at i and i + h. Ranks are hashes of such
pairs, so they are the same in every task and need no numbering pass. Spark sorts
positions by rank at growing lengths, and positions whose rank is unique drop out:

1. Ranks over ``SEED`` bytes, formed by doubling from 8. Not every position is sorted:
   each window of ``length`` bytes picks its least seed, and equal windows pick the
   same one, so it is enough to sort the picked positions (about one in 85). A
   seed that occurs once ends all windows that picked it.
2. Consecutive windows that picked the same seed form a stretch; its rank over all
   its bytes (up to ``2 * length - SEED``) joins ranks at growing offsets. Stretches
   that are equal as a whole are past the threshold: all their windows repeat.
3. Of seeds with several different stretches, one of each takes part, by blocks of windows.
   A block whose common bytes are unique is done, as is one that is equal as a whole.
   Only the rest are compared window by window, at ``length`` bytes.

What is carried on are the *unique* windows, so a passage in a third of all texts
is counted in partial sums and never gathered. Stretches are counted with their
seed, so two of them are mixed up only if 64-bit hashes meet among those with one seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hailgrid.llm import text as T
from hailgrid.llm.storage import release, stored

SEED = 32
# Windows of a stretch that are compared together before each is.
BLOCK = 16
# Texts are ranked in parts of so many windows, which bounds memory; positions in a part fit in 24 bits.
PART = 4 << 20
_K = np.uint64(0x9FB21C651E98DF25)
_PLACE = np.uint64((1 << 24) - 1)


def _seed_ranks(data: np.ndarray) -> np.ndarray:
    """The rank of each position at SEED bytes: doubled from the 8 bytes read as a number."""
    count = len(data) - 7
    ranks = T.mix(np.ndarray((count,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64))
    h = 8
    while h < SEED:
        ranks = T.mix(ranks[:-h] * _K + ranks[h:])
        h *= 2
    return ranks


def _joined(ranks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The rank of each byte range of at least SEED bytes, from ranks at growing offsets; the last ends with it."""
    out = T.mix((ends - starts).astype(np.uint64))
    last = ends - SEED
    for step in range(0, int((last - starts).max(initial=0)) + SEED, SEED):
        more = starts + step < last + SEED
        at = np.minimum(starts + step, last)
        out = np.where(more, T.mix(out * _K + ranks[at]), out)
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _stretches(data: np.ndarray, offsets: np.ndarray, length: int):
    """(row, seed rank, stretch rank, first and last window, seed's place) of the stretches of a block, places in the text."""
    width = length - SEED + 1
    out = []
    for begin in range(0, max(1, len(data) - length + 1), PART):
        part = data[begin : begin + PART + length - 1]
        if len(part) < length:
            continue
        ranks = _seed_ranks(part)
        places = np.arange(len(ranks), dtype=np.uint64)
        picked = (_least((ranks & ~_PLACE) | places, width) & _PLACE).astype(np.int64)
        # Windows over the end of a text are none.
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[begin : begin + len(picked)]
        whole = np.arange(begin, begin + len(picked)) + length <= offsets[row + 1]
        new = whole.copy()
        new[1:] &= (picked[1:] != picked[:-1]) | ~whole[:-1] | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        stops = whole.copy()
        stops[:-1] &= new[1:] | ~whole[1:]
        last = np.flatnonzero(stops)
        seeds = ranks[picked[first]]
        spans = _joined(ranks, first, last + length) + T.mix((picked[first] - first).astype(np.uint64))
        rows = row[first]
        out.append((rows, seeds, spans, first + begin - offsets[rows], last + begin - offsets[rows], picked[first] + begin - offsets[rows]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else None


def _find_stretches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = (batch.column(c).to_numpy() for c in ("doc", "key"))
            for block in T.blocks(batch.column("text")):
                if (found := _stretches(block.data, block.offsets, length)) is None:
                    continue
                rows, seeds, spans, first, last, places = found
                # Repeats within a block are counted here.
                pair = T.mix(seeds + _K) ^ spans
                _, at, n = np.unique(pair, return_index=True, return_counts=True)
                rows = rows[at] + block.first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (seeds[at].view(np.int64), spans[at].view(np.int64), n.astype(np.int64), docs[rows], keys[rows], first[at].astype(np.int32), last[at].astype(np.int32), places[at].astype(np.int32))],
                    ["seed", "span", "n", "doc", "key", "first", "last", "at"],
                )

    return run


def _ranked(batch: pa.RecordBatch, text: str, length: int, names: tuple[str, ...]):
    """For parts of a batch with lists of window runs: (rows, the runs' ``names``, text begins, run and place of each window, its rank, all ranks)."""
    lists = batch.column("open")
    for block in T.blocks(batch.column("row").field(text)):
        found = lists.slice(block.first, block.rows)
        entries = found.flatten()
        row = np.repeat(np.arange(block.rows), found.value_lengths().to_numpy())
        fields = [entries.field(c).to_numpy() for c in names]
        first, last = (entries.field(c).to_numpy() for c in ("first", "last"))
        begin = 0
        while begin < len(row):
            # Runs of neighbouring texts, ranked together up to PART windows.
            end = begin + max(1, int(np.searchsorted(np.cumsum(last[begin:] - first[begin:] + 1), PART)))
            cut = slice(begin, end)
            begin = end
            base = block.offsets[row[cut]]
            low, high = int((first[cut] + base).min()), int((last[cut] + base).max()) + length
            ranks = _seed_ranks(block.data[low:high])
            count = (last[cut] - first[cut] + 1).astype(np.int64)
            of = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[cut][of]
            start = place + base[of] - low
            yield row[cut] + block.first, [x[cut] for x in fields], base - low, of, place, _joined(ranks, start, start + length), ranks


def _find_blocks(length: int, text: str):
    """Rows (part, whole, n, doc, key, first, last): blocks of windows of the stretches that seeds don't settle.

    Windows are put in blocks of BLOCK by the distance of their seed, so equal windows
    are in the same one. ``part`` ranks the bytes that all windows of a block share, and
    ``whole`` all its windows together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = (batch.column(c).to_numpy() for c in ("doc", "key"))
            for rows, (seed, n, at), base, of, place, windows, ranks in _ranked(batch, text, length, ("seed", "n", "at")):
                far = at[of] - place
                group = far // BLOCK
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (group[1:] != group[:-1])
                heads = np.flatnonzero(new)
                stops = np.append(heads[1:], len(of))
                run_of, group = of[heads], group[heads]
                latest = (at + base)[run_of] - group * BLOCK
                part = _joined(ranks, latest, latest - BLOCK + 1 + length) ^ T.mix(seed[run_of].view(np.uint64) + group.astype(np.uint64))
                total = np.concatenate(([np.uint64(0)], np.cumsum(T.mix(windows + far.astype(np.uint64) * _K), dtype=np.uint64)))
                whole = T.mix(total[stops] - total[heads])
                texts = rows[run_of]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(x)
                        for x in (T.mix(part).view(np.int64), whole.view(np.int64), n[run_of], docs[texts], keys[texts], place[heads].astype(np.int32), place[stops - 1].astype(np.int32))
                    ],
                    ["part", "whole", "n", "doc", "key", "first", "last"],
                )

    return run


def _find_windows(length: int, text: str):
    """Rows (part, window, n, doc, key, first): the windows of the blocks that are open still."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = (batch.column(c).to_numpy() for c in ("doc", "key"))
            for rows, (part, n), _, of, place, windows, _ in _ranked(batch, text, length, ("part", "n")):
                texts = rows[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (part[of], windows.view(np.int64), n[of], docs[texts], keys[texts], place.astype(np.int32))],
                    ["part", "window", "n", "doc", "key", "first"],
                )

    return run


def removed_runs(size: int, length: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The (start, end) byte runs that windows other than the unique ones (first to last) cover."""
    windows = size - length + 1
    if windows <= 0:
        return np.zeros((0, 2), np.int64)
    unique = np.zeros(windows + 1, np.int32)
    np.add.at(unique, first, 1)
    np.add.at(unique, last + 1, -1)
    repeated = np.cumsum(unique[:-1]) == 0
    edges = np.diff(np.concatenate(([0], repeated, [0])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + length - 1
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    # Runs that touch or overlap are one.
    gap = np.concatenate(([True], starts[1:] > ends[:-1]))
    stop = np.concatenate((gap[1:], [True]))
    return np.stack((starts[gap], ends[stop]), 1)


def whole_characters(data: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The runs without the parts of characters at their ends."""
    borders = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    starts = borders[np.searchsorted(borders, runs[:, 0])]
    ends = borders[np.searchsorted(borders, runs[:, 1], side="right") - 1]
    return np.stack((starts, ends), 1)[starts < ends]


def without(data: np.ndarray, runs: np.ndarray) -> bytes:
    if not len(runs):
        return data.tobytes()
    gone = np.zeros(len(data) + 1, np.int8)
    np.add.at(gone, runs[:, 0], 1)
    np.add.at(gone, runs[:, 1], -1)
    return data[np.cumsum(gone[:-1]) == 0].tobytes()


def _removed(batch: pa.RecordBatch, text: str, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, bytes, removed runs) of each row of a batch."""
    for block in T.blocks(batch.column("row").field(text)):
        found = batch.column("unique").slice(block.first, block.rows)
        entries = found.flatten()
        first, last = entries.field("first").to_numpy(), entries.field("last").to_numpy()
        bounds = np.concatenate(([0], np.cumsum(found.value_lengths().fill_null(0).to_numpy())))
        for i in range(block.rows):
            own = slice(int(bounds[i]), int(bounds[i + 1]))
            data = block.data[block.offsets[i] : block.offsets[i + 1]]
            yield block.first + i, data, removed_runs(len(data), length, first[own], last[own])


def _spans_and_bytes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, runs, kept = [], [], []
            for _, data, own in _removed(batch, "text", length):
                sizes.append(len(data))
                runs.append(own)
                kept.append(without(data, own))
            pairs = np.concatenate(runs)
            spans = pa.ListArray.from_arrays(
                np.cumsum([0, *map(len, runs)]).astype(np.int32), pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["start", "end"])
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").field("doc_id"), pa.array(sizes, pa.int64()), spans, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"]
            )

    return run


def _rewritten(length: int, names: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [without(data, whole_characters(data, runs)).decode(errors="replace") for _, data, runs in _removed(batch, text, length)]
            arrays = batch.column("row").flatten()
            there = arrays[names.index(text)].is_valid().to_pylist()
            arrays[names.index(text)] = pa.array([k if ok else None for k, ok in zip(kept, there, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _with_unique(docs: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``unique``, the windows (first, last) of its text that start nowhere else."""
    if length < 2 * SEED:
        raise ValueError(f"a passage has at least {2 * SEED} bytes")
    # Id and hash of the text find a row again; equal rows have equal windows.
    keyed = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("doc"),
        F.xxhash64(F.col(text), F.col(doc_id).isNull()).alias("key"),
    )
    place = "doc long, key long, first int"

    def settled(ranked: DataFrame, group: str, whole: str, *carried: str) -> DataFrame:
        """One row of each (group, whole), but for groups that are all the same and repeat; ``open`` if others are in the group."""
        counted = ranked.repartition(group).groupBy(group, whole).agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("doc", "key", "first", *carried)])
        others = counted.withColumn("open", F.count("*").over(Window.partitionBy(group)) > 1).where("n = 1 or open")
        # What only open rows need is left out of the rest.
        return stored(others.select(F.when(F.col("open"), F.col(group)).alias(group), "n", "doc", "key", "first", *carried, "open"))

    def texts_with(rows: DataFrame, *names: str) -> DataFrame:
        lists = rows.where("open").groupBy("doc", "key").agg(F.collect_list(F.struct(*names)).alias("open"))
        return keyed.join(lists, ["doc", "key"])

    stretches = keyed.select("doc", "key", F.col("row")[text].alias("text")).mapInArrow(_find_stretches(length), f"seed long, span long, n long, {place}, last int, at int")
    by_seed = settled(stretches, "seed", "span", "last", "at")
    release(docs.sparkSession)

    # Of each different stretch of a seed one is ranked again, by blocks of its windows.
    blocks = texts_with(by_seed, "seed", "n", "first", "last", "at").mapInArrow(_find_blocks(length, text), f"part long, whole long, n long, {place}, last int")
    by_block = settled(blocks, "part", "whole", "last")
    release(docs.sparkSession)

    # Of each different block with the same part, each window is compared.
    windows = texts_with(by_block, "part", "n", "first", "last").mapInArrow(_find_windows(length, text), f"part long, window long, n long, {place}")
    by_window = windows.groupBy("part", "window").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("doc", "key", "first")]).where("n = 1")
    single = stored(by_window.select("doc", "key", "first", F.col("first").alias("last")))
    release(docs.sparkSession)

    unique, *more = (x.select("doc", "key", "first", "last") for x in (by_seed.where("not open"), by_block.where("not open"), single))
    for rows in more:
        unique = unique.union(rows)
    unique = unique.groupBy("doc", "key").agg(F.collect_list(F.struct("first", "last")).alias("unique"))
    return keyed.join(unique, ["doc", "key"], "left").select("row", "unique")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of each row: its byte runs covered by repeated strings, and its other bytes.

    A string repeats if the same ``length`` bytes start anywhere else, in the same
    text or another, overlaps included; matches never cross texts. Spans are maximal
    (start, end) runs in order. Null texts count as empty; texts shorter than ``length``
    have no spans; of a repeated row both rows are covered. Null ids are kept. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _with_unique(rows, "doc_id", "text", length).mapInArrow(
        _spans_and_bytes(length), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, n_chars: str | None = None) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``, all rows and columns kept; see ``repeated_spans``.

    Characters that a repeated string covers in part stay, so texts remain valid. The
    column ``n_chars``, if it is named, becomes the new length.
    """
    kept = _with_unique(docs, doc_id, text, length).mapInArrow(_rewritten(length, docs.columns, text), docs.schema)
    return kept.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars else kept
