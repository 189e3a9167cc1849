"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A window
(one word, A-Z in lower case) is compressed with both; it is toxic if the toxic dictionary
saves at least a calibrated share of its bytes more. Lengths are whole bytes, and a short
word saves less than one; each letter is therefore written as a four-byte code of the
word up to it, so that a known word is one long match, one with a known beginning is
matched so far, and an unknown one is not compressed at all.

Most words of a toxic document are ordinary. Toxic text for training is what toxic
documents say and ordinary ones don't: windows count once per document (copies of a text
are one), and those that are not far likelier in toxic documents are left out.

Calibration chooses the share on another part of the same bounded sample, and fits for each label
how often windows of its documents are toxic: a mixture of rates, by expectation and
maximisation. The score is the chance of the label given how many of a document's windows are
toxic and how many are not, so it follows the rate: many ordinary texts in a row score no
higher than one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailgrid.llm import text as T
from hailgrid.llm.sampling import labelled_sample

# Shares of a window are told apart in so many steps when calibrating.
MARGINS = 24
REMEMBERED = 1_000_000
# A toxic window stands in at least this share of the toxic documents.
TELLING_SHARE = 0.005
# Rates of toxic windows that documents may have, and the weight of a rate that none has.
RATES = np.geomspace(2e-4, 0.6, 18)
UNSEEN = 0.05


class ToxicityModel(NamedTuple):
    toxic: bytes
    ordinary: bytes
    margin: int
    # Weights of the rates in ordinary and in toxic documents, and the share of toxic ones.
    rates: tuple[tuple[float, ...], tuple[float, ...]]
    prior: float

    def scores(self, toxic: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """The chance that documents with so many toxic windows, of all their windows, are toxic."""
        ordinary, marked = (_log_sum(_log_chances(toxic, windows, np.array(w))) for w in self.rates)
        with np.errstate(over="ignore"):
            return self.prior / (self.prior + (1 - self.prior) * np.exp(ordinary - marked))


def _log_chances(toxic: np.ndarray, windows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Documents x rates: logarithm of a rate's weight and of its chance to mark just these windows."""
    return np.log(weights) + np.multiply.outer(toxic, np.log(RATES)) + np.multiply.outer(windows - toxic, np.log1p(-RATES))


def _log_sum(logs: np.ndarray) -> np.ndarray:
    most = logs.max(1)
    return most + np.log(np.exp(logs - most[:, None]).sum(1))


def _fitted_rates(toxic: np.ndarray, windows: np.ndarray, times: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of the rates that make the documents likeliest; each row stands for ``times`` documents."""
    weights = np.full(len(RATES), 1 / len(RATES))
    for _ in range(steps):
        logs = _log_chances(toxic, windows, weights)
        share = np.exp(logs - _log_sum(logs)[:, None]) * times[:, None]
        weights = (share.sum(0) + UNSEEN) / (times.sum() + UNSEEN * len(RATES))
    return weights


def codes_of(word: str) -> bytes:
    """Four bytes for each beginning of a word, and for its end."""
    code, out = 0x9E3779B97F4A7C15, []
    for point in (*map(ord, word), 0):
        code = (code ^ point) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        code ^= code >> 32
        out.append(code & 0xFFFFFFFF)
    return np.array(out, "<u4").tobytes()


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(
        1, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    if not dictionary:
        return zstandard.ZstdCompressor(compression_params=settings)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=settings)


class _Margins:
    """Steps of a window's bytes that the toxic dictionary saves more than the ordinary one; remembered by the worker."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)
        self.words = T.WordTable(REMEMBERED)
        self.generation, self.margins = 0, np.zeros(0, np.int16)

    def of(self, block: T.Block, found: T.Words) -> np.ndarray:
        numbers, new = self.words.find(found.hashes)
        if self.generation != self.words.generation:
            self.generation, self.margins = self.words.generation, np.zeros(0, np.int16)
        if len(new):
            data = T.LOWER[block.data].tobytes()
            values = np.empty(len(new), np.int16)
            for i, (s, e) in enumerate(zip(found.starts[new].tolist(), found.ends[new].tolist(), strict=True)):
                code = codes_of(data[s:e].decode(errors="replace"))
                saved = len(self.ordinary.compress(code)) - len(self.toxic.compress(code))
                values[i] = MARGINS * saved // len(code)
            self.margins = np.concatenate((self.margins, values))
        return self.margins[numbers]


@lru_cache(maxsize=2)
def _margins(toxic: bytes, ordinary: bytes) -> _Margins:
    return _Margins(toxic, ordinary)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, document, label): each window of each text of the sample with a hash of the text, once."""
    is_word = T.is_word_byte("alnum")
    for batch in batches:
        labels = batch.column("label").to_numpy()
        for block in T.blocks(batch.column("text")):
            found = T.words(block, is_word)
            if not len(found.hashes):
                continue
            toxic = np.repeat(labels[block.first : block.first + block.rows], np.diff(found.of_row))
            document = np.repeat(T.hash_ranges(block.data, block.offsets[:-1], block.offsets[1:]), np.diff(found.of_row))
            _, keep = np.unique(T.mix(found.hashes + document * np.uint64(3)) ^ toxic.astype(np.uint64), return_index=True)
            data = T.LOWER[block.data].tobytes()
            spelled = [data[s:e].decode(errors="replace") for s, e in zip(found.starts[keep].tolist(), found.ends[keep].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(spelled), pa.array(document[keep].view(np.int64)), pa.array(toxic[keep])], ["word", "document", "label"])


def _counted(toxic: bytes, ordinary: bytes):
    """Rows (label, margin, n, windows): for each document and margin from 1, its windows with at least that margin, and all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word, margins = T.is_word_byte("alnum"), _margins(toxic, ordinary)
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for block in T.blocks(batch.column("text")):
                found = T.words(block, is_word)
                own = margins.of(block, found)
                counts = np.stack([_per_row(own >= m, found.of_row) for m in range(1, MARGINS + 1)], 1)
                label = np.repeat(labels[block.first : block.first + block.rows], MARGINS)
                margin = np.tile(np.arange(1, MARGINS + 1, dtype=np.int32), block.rows)
                windows = np.repeat(np.diff(found.of_row), MARGINS)
                yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(margin), pa.array(counts.ravel()), pa.array(windows)], ["label", "margin", "n", "windows"])

    return run


def _per_row(marked: np.ndarray, of_row: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(marked)))
    return sums[of_row[1:]] - sums[of_row[:-1]]


def _train(windows: list[str], size: int) -> bytes:
    """A content dictionary: the codes of the windows, the commonest last, where matches are cheapest."""
    out, room = [], size
    for window in windows:
        code = codes_of(window)
        if len(code) > room:
            break
        out.append(code)
        room -= len(code)
    return b"".join(reversed(out))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    doc_id: str = "doc_id",
    text: str = "text",
    sample_rows: int = 6000,
    toxic_bytes: int = 16384,
    ordinary_bytes: int = 65536,
) -> ToxicityModel:
    """Dictionaries and calibration from at most about ``sample_rows`` documents of each label (0 ordinary, 1 toxic).

    Null texts and labels are left out. Without rows of both labels the model scores all texts alike.
    """
    sample, shares = labelled_sample(docs, labels, label, sample_rows, doc_id, text)
    sample = sample.where("text is not null")
    # Two thirds train the dictionaries, the rest calibrates. Equal texts are in the same part.
    spare = F.pmod(F.xxhash64("text", F.lit("part")), F.lit(3)) == 0
    words = (
        sample.where(~spare).mapInArrow(_windows, "word string, document long, label int")
        .groupBy("word", "label", "document").agg(F.lit(1))
        .groupBy("word")
        .agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("ordinary"))
    )
    # Bounded by the dictionaries' sizes: only the commonest windows are trained on.
    common = words.orderBy(F.desc("ordinary"), "word").where("ordinary > 0").limit(ordinary_bytes // 4).collect()
    # Words count different texts, and so do the totals that they are held against.
    texts = sample.where(~spare).select(F.xxhash64("text").alias("document"), "label").distinct()
    total = texts.agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("ordinary")).first()
    ratio = max(1, total["ordinary"]) / max(1, total["toxic"])
    # A window of few toxic documents may be theirs by chance.
    marked = words.where(F.col("toxic") >= max(3, total["toxic"] * TELLING_SHARE)).where(F.col("toxic") * ratio > 8 * F.col("ordinary") + 8)
    telling = marked.orderBy(F.desc("toxic"), "word").limit(toxic_bytes // 4).collect()
    ordinary = _train([r["word"] for r in common], ordinary_bytes)
    toxic = _train([r["word"] for r in telling], toxic_bytes)

    # As many rows as the sample has documents and margins, at most.
    counted = sample.where(spare).mapInArrow(_counted(toxic, ordinary), "label int, margin int, n long, windows long")
    table = counted.groupBy("label", "margin", "n", "windows").count().toArrow()
    labels_, margins, n, windows, times = (table.column(c).to_numpy() for c in ("label", "margin", "n", "windows", "count"))
    order = np.lexsort((windows, n, labels_, margins))
    labels_, margins, n, windows, times = (x[order] for x in (labels_, margins, n, windows, times))
    even = tuple(1 / len(RATES) for _ in RATES)
    best, model = -np.inf, ToxicityModel(toxic, ordinary, MARGINS, (even, even), 0.0)
    if len(set(labels_.tolist())) == 2:
        # Ordinary rows may have been sampled more thinly; the share of toxic ones is that of all labelled rows.
        prior = shares[1] / (shares[0] + shares[1])
        first = margins == 1
        sampled = [times[first & (labels_ == y)].sum() for y in (0, 1)]
        for m in range(1, MARGINS + 1):
            own = margins == m
            parts = [own & (labels_ == y) for y in (0, 1)]
            rates = tuple(tuple(_fitted_rates(n[p], windows[p], times[p]).tolist()) for p in parts)
            tried = ToxicityModel(toxic, ordinary, m, rates, prior)
            fit = 0.0
            for y, p in enumerate(parts):
                score = np.clip(tried.scores(n[p], windows[p]), 1e-9, 1 - 1e-9)
                fit += float((np.log(score if y else 1 - score) * times[p]).sum()) * shares[y] / sampled[y]
            if fit > best:
                best, model = fit, tried
    return model


def _scored(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word, margins = T.is_word_byte("alnum"), _margins(model.toxic, model.ordinary)
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                found = T.words(block, is_word)
                counts = _per_row(margins.of(block, found) >= model.margin, found.of_row)
                scores = model.scores(counts, np.diff(found.of_row))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.rows), pa.array(scores), pa.array(counts)], ["doc_id", "score", "toxic_windows"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, toxic_windows`` of each row: the chance that it is toxic, from its whole text.

    Null, empty and wordless texts have no windows and the share of toxic labels as their score. Null
    ids are kept, repeated rows scored alike, other columns ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scored(model), "doc_id long, score double, toxic_windows long")


def _clean(model: ToxicityModel, names: list[str], text: str, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word, margins = T.is_word_byte("alnum"), _margins(model.toxic, model.ordinary)
        for batch in batches:
            for block in T.blocks(batch.column(names.index(text))):
                found = T.words(block, is_word)
                counts = _per_row(margins.of(block, found) >= model.margin, found.of_row)
                stay = np.flatnonzero(model.scores(counts, np.diff(found.of_row)) < limit) + block.first
                yield batch.take(pa.array(stay))

    return run


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", limit: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns; see ``score_toxicity``."""
    return docs.mapInArrow(_clean(model, docs.columns, text, limit), docs.schema)
