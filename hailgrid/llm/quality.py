"""Quality scores by a factorisation machine.

A text has three kinds of features: its words, hashed to buckets; statistics of its
structure; and metadata columns. Each feature has a weight and a short vector, and a pair
of features interacts with the product of their vectors. The sum over all pairs is half the
square of the summed vectors less their summed squares, so scoring is linear in the features.

The model is fitted in the driver by gradient steps on the sparse features of a bounded
sample of labelled rows; scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailgrid.llm import text as T
from hailgrid.llm.sampling import labelled_sample

STATISTICS = (
    "bytes", "words", "word_length", "letters", "digits", "capitals", "signs", "non_ascii", "lines", "line_length",
    "repeated_lines", "distinct_words", "commonest_word", "short_words", "long_words", "signs_at_word_ends",
)
# Statistics and metadata are cut into so many overlapping steps, each a feature of its own.
STEPS = 12


class QualityModel(NamedTuple):
    buckets: int
    metadata: tuple[str, ...]
    borders: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray


def _class_table(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_LETTER = _class_table(i for i in range(256) if i >= 128 or chr(i).isalpha())
_DIGIT = _class_table(range(48, 58))
_CAPITAL = _class_table(range(65, 91))
_SIGN = _class_table(i for i in range(33, 127) if not chr(i).isalnum())
_HIGH = _class_table(range(128, 256))
_NOT_NEWLINE = ~_class_table([10])
_WORD = T.is_word_byte("space")


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _distinct(rows: np.ndarray, hashes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: its distinct hashes, and how often the commonest occurs."""
    key = T.mix(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    most = np.zeros(count, np.int64)
    np.maximum.at(most, rows[first], n)
    return np.bincount(rows[first], minlength=count), most


def _block_features(block: T.Block, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and values of the word features of a block, and its statistics (rows x STATISTICS)."""
    found = T.words(block, _WORD)
    n = block.rows
    counts = np.diff(found.of_row)
    row = np.repeat(np.arange(n), counts)
    key = row * buckets + (found.hashes % np.uint64(buckets)).astype(np.int64)
    entries, times = np.unique(key, return_counts=True)
    rows, values = entries // buckets, np.log1p(times)
    values /= np.sqrt(np.bincount(rows, values * values, minlength=n))[rows]

    size = np.diff(block.offsets)
    lengths = found.ends - found.starts
    line_starts, line_ends, of_row = T.spans_of(_NOT_NEWLINE[block.data], block.offsets)
    lines = np.diff(of_row)
    line_row = np.repeat(np.arange(n), lines)
    distinct_lines, _ = _distinct(line_row, T.hash_ranges(block.data, line_starts, line_ends), n)
    distinct_words, commonest = _distinct(row, found.hashes, n)
    ends_with_sign = _SIGN[block.data[found.ends - 1]] & ~np.isin(block.data[found.ends - 1], list(b".,"))
    per_byte, per_word, per_line = np.maximum(size, 1), np.maximum(counts, 1), np.maximum(lines, 1)
    statistics = np.stack(
        [
            np.log1p(size),
            np.log1p(counts),
            _row_sums(lengths, found.of_row) / per_word,
            *[_row_sums(table[block.data], block.offsets) / per_byte for table in (_LETTER, _DIGIT, _CAPITAL, _SIGN, _HIGH)],
            np.log1p(lines),
            np.log1p(size / per_line),
            1 - distinct_lines / per_line,
            distinct_words / per_word,
            commonest / per_word,
            _row_sums(lengths <= 3, found.of_row) / per_word,
            _row_sums(lengths > 12, found.of_row) / per_word,
            _row_sums(ends_with_sign, found.of_row) / per_word,
        ],
        1,
    )
    return rows, entries % buckets, values, statistics


def _extra(batch: pa.RecordBatch, metadata: tuple[str, ...]) -> np.ndarray:
    """The metadata columns on a log scale; null and non-finite values count as -1."""
    out = []
    for name in metadata:
        values = np.array(batch.column(name).cast(pa.float64()).fill_null(-1.0))
        values = np.where(np.isfinite(values), values, -1.0)
        out.append(np.sign(values) * np.log1p(np.abs(values)))
    return np.stack(out, 1) if out else np.zeros((batch.num_rows, 0))


def _features(metadata: tuple[str, ...], buckets: int):
    """Rows (label, weight, buckets, values, statistics) of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = _extra(batch, metadata)
            for block in T.blocks(batch.column("text")):
                rows, ids, values, statistics = _block_features(block, buckets)
                bounds = np.searchsorted(rows, np.arange(block.rows + 1)).astype(np.int32)
                dense = np.concatenate((statistics, extra[block.first : block.first + block.rows]), 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label").slice(block.first, block.rows),
                        pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32))),
                        pa.ListArray.from_arrays(bounds, pa.array(values.astype(np.float32))),
                        pa.ListArray.from_arrays(np.arange(block.rows + 1, dtype=np.int32) * dense.shape[1], pa.array(dense.ravel())),
                    ],
                    ["label", "ids", "values", "statistics"],
                )

    return run


def _steps(dense: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Each statistic as STEPS values between 0 and 1: how far it is through each step."""
    low, high = borders[:, :-1], borders[:, 1:]
    return np.clip((dense[:, :, None] - low) / np.maximum(high - low, 1e-9), 0, 1).reshape(len(dense), -1)


def _raw(rows, ids, values, dense, bias, weights, vectors, buckets) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the machine before the logistic function, and the summed vectors."""
    n = len(dense)
    linear = np.bincount(rows, weights[ids] * values, minlength=n) + dense @ weights[buckets:]
    summed = dense @ vectors[buckets:]
    squared = (dense * dense) @ (vectors[buckets:] ** 2)
    for f in range(vectors.shape[1]):
        part = vectors[ids, f] * values
        summed[:, f] += np.bincount(rows, part, minlength=n)
        squared[:, f] += np.bincount(rows, part * part, minlength=n)
    return bias + linear + 0.5 * (summed**2 - squared).sum(1), summed


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
    metadata: tuple[str, ...] = (),
    sample_rows: int = 4000,
    buckets: int = 1 << 13,
    rank: int = 6,
    epochs: int = 12,
    rate: float = 0.05,
    decay: float = 1e-4,
) -> QualityModel:
    """A machine from at most about ``sample_rows`` documents of each label (0 or 1), weighted to the labels' true shares.

    The driver holds the sample's features, at most ``2 * sample_rows * buckets`` numbers.
    Null labels are left out; null texts count as empty. Without rows the score is 0.5.
    """
    sample, shares = labelled_sample(docs, labels, label, sample_rows, doc_id, text, metadata)
    table = sample.mapInArrow(_features(metadata, buckets), "label int, ids array<int>, values array<float>, statistics array<double>").toArrow()
    width = len(STATISTICS) + len(metadata)
    wide = width * STEPS
    if not table.num_rows:
        return QualityModel(buckets, metadata, np.zeros((width, STEPS + 1)), 0.0, np.zeros(buckets + wide), np.zeros((buckets + wide, rank)))
    y = table["label"].to_numpy().astype(float)
    ids, values = (table[c].combine_chunks() for c in ("ids", "values"))
    bounds = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
    ids, values = ids.flatten().to_numpy(), values.flatten().to_numpy().astype(float)
    raw = table["statistics"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    borders = np.quantile(raw, np.linspace(0, 1, STEPS + 1), axis=0).T
    dense = _steps(raw, borders)
    # Rows come in any order from the tasks; a fixed order makes the fit repeatable.
    order = np.lexsort((bounds[1:] - bounds[:-1], *raw.T))
    random = np.random.default_rng(1)
    weights, vectors, bias = np.zeros(buckets + wide), random.normal(0, 0.02, (buckets + wide, rank)), 0.0
    seen_w, seen_v, seen_b = np.full(buckets + wide, 1e-6), np.full((buckets + wide, rank), 1e-6), 1e-6
    importance = np.where(y == 1, shares.get(1, 0) / max(1, (y == 1).sum()), shares.get(0, 0) / max(1, (y == 0).sum()))
    importance /= importance.mean()
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(order), max(1, len(order) // 64)):
            count = bounds[batch + 1] - bounds[batch]
            at = np.repeat(bounds[batch] - np.cumsum(count) + count, count) + np.arange(count.sum())
            own, i, x, d = np.repeat(np.arange(len(batch)), count), ids[at], values[at], dense[batch]
            z, summed = _raw(own, i, x, d, bias, weights, vectors, buckets)
            g = (_logistic(z) - y[batch]) * importance[batch] / len(batch)
            used, place = np.unique(i, return_inverse=True)
            every = np.concatenate((used, np.arange(buckets, buckets + wide)))
            gw = np.concatenate((np.bincount(place, g[own] * x, minlength=len(used)), g @ d)) + decay * weights[every]
            gx = g[own] * x
            word_part = np.stack([np.bincount(place, gx * summed[own, f], minlength=len(used)) for f in range(rank)], 1)
            word_part -= np.bincount(place, gx * x, minlength=len(used))[:, None] * vectors[used]
            stat_part = (d * g[:, None]).T @ summed - ((d * d) * g[:, None]).sum(0)[:, None] * vectors[buckets:]
            gv = np.concatenate((word_part, stat_part)) + decay * vectors[every]
            seen_w[every] += gw**2
            seen_v[every] += gv**2
            seen_b += g.sum() ** 2
            weights[every] -= rate * gw / np.sqrt(seen_w[every])
            vectors[every] -= rate * gv / np.sqrt(seen_v[every])
            bias -= rate * g.sum() / np.sqrt(seen_b)
    return QualityModel(buckets, metadata, borders, float(bias), weights, vectors)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            extra = _extra(batch, m.metadata)
            for block in T.blocks(batch.column("text")):
                rows, ids, values, statistics = _block_features(block, m.buckets)
                dense = _steps(np.concatenate((statistics, extra[block.first : block.first + block.rows]), 1), m.borders)
                score = _logistic(_raw(rows, ids, values, dense, m.bias, m.weights, m.vectors, m.buckets)[0])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.rows), pa.array(score)], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of each row: the chance that its label is 1, from the whole text and the model's metadata columns.

    Null texts count as empty, which have statistics but no words; null metadata is a value
    of its own. Null ids are kept, repeated rows scored alike, other columns ignored. The
    model is broadcast; its size is fixed by its buckets and rank.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in model.metadata if c not in ("doc_id", "text")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *names)
    return rows.mapInArrow(_scored(shared), "doc_id long, score double")
