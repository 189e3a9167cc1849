"""Language identification by unigram pieces, with all segmentations summed.

A language gives each piece of a public vocabulary a probability. A word's probability is
the sum over all ways to cut it into pieces of the product of theirs; the forward
algorithm adds it up from left to right. A text is scored by its words.

Training starts from the order of the vocabulary, the same for all languages, and takes
steps of expectation and maximisation: the forward and backward sums give each piece's
expected count in the words of each language, and the counts give the next
probabilities. Each step is a Spark job over the distinct words of a bounded sample; what
reaches the driver has the vocabulary's size for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailgrid.checkpoints import keep
from hailgrid.llm import text as T
from hailgrid.llm.pieces import Trie, load_pieces, trie

REMEMBERED = 600_000
# Numbers held at once for words that are scored side by side.
SIDE_BY_SIDE = 1 << 21
# Sums below this are scaled up; a piece is far likelier than its inverse is large.
SMALL = 1e-60

_LETTERS = np.array([i >= 128 or chr(i).isalpha() for i in range(256)])
_ASCII_LETTERS = _LETTERS & (np.arange(256) < 128)


class LanguageModel(NamedTuple):
    vocabulary: str
    languages: tuple[str, ...]
    prior: np.ndarray
    pieces: np.ndarray


def _words(block: T.Block) -> T.Words:
    """The letter runs of a block, of any length."""
    return T.words(block, _LETTERS)


@lru_cache(maxsize=4)
def longest_piece(vocabulary: str) -> int:
    """Bytes of the longest piece that a word can hold: letters, after a blank or not."""
    letters = _LETTERS.nonzero()[0].astype(np.uint8).tobytes()
    return max(len(p) for p in load_pieces(vocabulary) if not p.removeprefix(b" ").translate(None, letters))


def _matrix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes in lower case after a blank, one per row, and their lengths."""
    size = ends - starts
    width = int(size.max(initial=0))
    at = starts[:, None] + np.arange(width)
    inside = np.arange(width) < size[:, None]
    out = np.zeros((len(starts), width + 1), np.uint8)
    out[:, 0] = 0x20
    out[:, 1:] = np.where(inside, T.LOWER[data[np.minimum(at, len(data) - 1)]], 0)
    return out, size + 1


def _side_by_side(size: np.ndarray, each: int) -> Iterator[np.ndarray]:
    """Words by length, as many at once as hold SIDE_BY_SIDE numbers at ``each`` a byte; one at least."""
    order = np.argsort(size, kind="stable")
    begin = 0
    while begin < len(order):
        # The last of a part is its longest.
        fits = np.arange(1, len(order) - begin + 1) * (size[order[begin:]] + 2) * each <= SIDE_BY_SIDE
        end = begin + max(1, int(np.argmin(fits)) if not fits.all() else len(fits))
        yield order[begin:end]
        begin = end


def _ends(t: Trie, words: np.ndarray, size: np.ndarray, rows: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(end, rows, pieces) of every piece that begins at a place of the words in ``rows``."""
    node = np.zeros(len(rows), np.int32)
    for end in range(start + 1, words.shape[1] + 1):
        node = t.next[t.inner[node], words[rows, end - 1]]
        on = (node >= 0) & (size[rows] >= end)
        rows, node = rows[on], node[on]
        if not len(rows):
            return
        piece = t.piece[node]
        there = piece >= 0
        if there.any():
            yield end, rows[there], piece[there]


def _log_sums(t: Trie, longest: int, pieces: np.ndarray, words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Logarithm of the sum over all segmentations of each word, in each language; words come by length.

    Only the sums of the last ``longest`` places are held, whatever a word's length, and are scaled
    before they become too small.
    """
    ring = np.zeros((longest + 1, len(words), pieces.shape[1]))
    ring[0] = 1
    logs, out = np.zeros(ring.shape[1:]), np.empty(ring.shape[1:])
    first = 0
    for start in range(words.shape[1] + 1):
        here = ring[start % len(ring)]
        done = int(np.searchsorted(size, start, side="right"))
        if done > first:
            with np.errstate(divide="ignore"):
                out[first:done] = np.log(here[first:done]) + logs[first:done]
            first = done
        if first == len(words):
            break
        if start % 16 == 15:
            most = ring[:, first:].max(0)
            low = (most < SMALL) & (most > 0)
            scale = np.where(low, most, 1.0)
            ring[:, first:] /= scale
            logs[first:] += np.log(scale)
        for end, rows, piece in _ends(t, words, size, np.arange(first, len(words)), start):
            ring[end % len(ring), rows] += here[rows] * pieces[piece]
        here[:] = 0
    # Without any segmentation, in a language that lacks the pieces.
    return np.maximum(out, -1e9)


def word_scores(t: Trie, longest: int, pieces: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.empty((len(starts), pieces.shape[1]))
    size = ends - starts
    for part in _side_by_side(np.maximum(size, longest), pieces.shape[1]):
        part = part[np.argsort(size[part], kind="stable")]
        words, length = _matrix(data, starts[part], ends[part])
        out[part] = _log_sums(t, longest, pieces, words, length)
    return out


def expected_counts(t: Trie, longest: int, pieces: np.ndarray, words: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected piece counts by language of words, by length, that occur ``counts`` (words x languages) times.

    Each byte is made likelier by the word's own mean, so that the sums of long words stay in range; the
    factors cancel out.
    """
    mean = np.exp(np.minimum(-_log_sums(t, longest, pieces, words, size) / size[:, None], 50))
    powers = [np.ones_like(mean)]
    for _ in range(longest):
        powers.append(powers[-1] * mean)
    shape = (len(words), words.shape[1] + 1, pieces.shape[1])
    forward, backward = np.zeros(shape), np.zeros(shape)
    forward[:, 0] = 1
    paths = []
    for start in range(words.shape[1]):
        first = int(np.searchsorted(size, start, side="right"))
        for end, rows, piece in _ends(t, words, size, np.arange(first, len(words)), start):
            forward[rows, end] += forward[rows, start] * pieces[piece] * powers[end - start][rows]
            paths.append((start, end, rows, piece))
    every = np.arange(len(words))
    weight = counts / np.maximum(forward[every, size], 1e-300)
    backward[every, size] = 1
    out = np.zeros_like(pieces)
    for start, end, rows, piece in reversed(paths):
        used = pieces[piece] * powers[end - start][rows] * backward[rows, end]
        backward[rows, start] += used
        np.add.at(out, piece, forward[rows, start] * used * weight[rows])
    return out


def _sampled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, label, n) of the sample's words, counted per block."""
    for batch in batches:
        labels = np.array(batch.column("label"))
        for block in T.blocks(batch.column("text")):
            found = _words(block)
            label = np.repeat(labels[block.first : block.first + block.rows], np.diff(found.of_row))
            _, first, n = np.unique(T.mix(found.hashes + label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
            data = T.LOWER[block.data].tobytes()
            spelled = [data[s:e] for s, e in zip(found.starts[first].tolist(), found.ends[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(spelled, pa.binary()), pa.array(label[first]), pa.array(n, pa.int64())], ["word", "label", "n"])


def _expectation(vocabulary: str, pieces, languages: int):
    """Rows (piece, label, n): expected counts over the words of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, longest, p = trie(vocabulary), longest_piece(vocabulary), pieces.value
        out = np.zeros_like(p)
        for batch in batches:
            size = np.array([len(w) for w in batch.column("word").to_pylist()], np.int64)
            ends = np.cumsum(size)
            data = np.frombuffer(b"".join(batch.column("word").to_pylist()) + b" ", np.uint8)
            counts = np.array(batch.column("counts").flatten()).reshape(-1, languages)
            for part in _side_by_side(np.maximum(size, longest), 2 * languages):
                part = part[np.argsort(size[part], kind="stable")]
                words, length = _matrix(data, ends[part] - size[part], ends[part])
                out += expected_counts(t, longest, p, words, length, counts[part])
        piece, label = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(label, pa.int64()), pa.array(out[piece, label])], ["piece", "label", "n"])

    return run


def fit_languages(
    labelled: DataFrame, vocabulary: str, text: str = "text", label: str = "lang", sample_rows: int = 1500, steps: int = 2, smoothing: float = 200.0, doc_id: str = "doc_id"
) -> LanguageModel:
    """Piece probabilities of each language, from at most about ``sample_rows`` rows of each.

    Rows are sampled by their id, so copies of a text have the same share in the sample as
    in the table. Rows with null language, text or id are left out. Without rows no language is learnt.
    """
    rows = labelled.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("name"))
    rows = rows.where("_id is not null and text is not null and name is not null")
    counts = {r["name"]: r["n"] for r in rows.groupBy("name").agg(F.count("*").alias("n")).collect()}
    names = tuple(sorted(counts))
    t = trie(vocabulary)
    start = np.where(np.bincount(t.piece[t.piece >= 0], minlength=t.size) > 0, 1 / (100.0 + np.arange(t.size)), 0)
    start = np.repeat((start / start.sum())[:, None], len(names), 1)
    prior = np.array([counts[n] for n in names], float)
    if not names:
        return LanguageModel(vocabulary, names, prior, start)
    spark = labelled.sparkSession
    languages = spark.createDataFrame([(n, i, min(1.0, sample_rows / counts[n])) for i, n in enumerate(names)], "name string, label long, share double")
    chosen = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1_000_000)) < F.col("share") * 1_000_000
    sample = rows.join(F.broadcast(languages), "name").where(chosen).select("text", "label")
    spelled = sample.mapInArrow(_sampled_words, "word binary, label long, n long")
    # One row per word with its count in each language.
    words = keep(
        spelled.groupBy("word").agg(*[F.sum(F.when(F.col("label") == i, F.col("n")).otherwise(0)).cast("double").alias(f"n{i}") for i in range(len(names))])
        .select("word", F.array(*[f"n{i}" for i in range(len(names))]).alias("counts"))
    )
    pieces = start
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(pieces)
        found = words.mapInArrow(_expectation(vocabulary, shared, len(names)), "piece long, label long, n double").groupBy("piece", "label").agg(F.sum("n").alias("n"))
        expected = np.zeros_like(start)
        for piece, which, n in found.collect():
            expected[piece, which] = n
        pieces = (expected + smoothing * start) / (expected.sum(0) + smoothing)
    return LanguageModel(vocabulary, names, prior / prior.sum(), pieces)


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        m = model.value
        t, longest = trie(m.vocabulary), longest_piece(m.vocabulary)
        names = np.array([*m.languages, "und"], object)
        words, generation, known = T.WordTable(REMEMBERED), 0, np.zeros((0, len(m.languages)))
        room = 0
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                found = _words(block)
                numbers, new = words.find(found.hashes)
                if generation != words.generation:
                    generation, room = words.generation, 0
                if room + len(new) > len(known):
                    known = np.concatenate((known[:room], np.zeros((max(len(new), room, 1 << 14), known.shape[1]))))
                if len(new):
                    known[room : room + len(new)] = word_scores(t, longest, m.pieces, block.data, found.starts[new], found.ends[new])
                    room += len(new)
                sums = np.stack([_row_sums(known[numbers, g], found.of_row) for g in range(len(m.languages))], 1) if m.languages else np.zeros((block.rows, 0))
                pick, score = np.full(block.rows, len(m.languages)), np.zeros(block.rows)
                ascii_letters = np.concatenate(([0], np.cumsum(_ASCII_LETTERS[block.data])))
                has = (ascii_letters[block.offsets[1:]] > ascii_letters[block.offsets[:-1]]) & bool(m.languages)
                for i in np.flatnonzero(~has & (np.diff(found.of_row) > 0)).tolist() if m.languages else ():
                    has[i] = bool(letter.search(block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().decode(errors="replace")))
                if has.any():
                    logs = sums[has] + np.log(np.maximum(m.prior, 1e-12))
                    likely = np.exp(logs - logs.max(1, keepdims=True))
                    pick[has] = logs.argmax(1)
                    score[has] = likely.max(1) / likely.sum(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, block.rows), pa.array(names[pick].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
                )

    return run


def _row_sums(values: np.ndarray, of_row: np.ndarray) -> np.ndarray:
    """Sums by row; each from its own values, as long running totals would lose digits."""
    filled = np.append(values, 0.0)
    out = np.add.reduceat(filled, of_row[:-1]) if len(of_row) > 1 else np.zeros(0)
    return np.where(of_row[1:] > of_row[:-1], out, 0.0)


def identify_languages(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of each row: the likeliest language of its whole text and its posterior probability.

    Texts that are null or hold no letter, and all texts if no language was learnt, are
    ``und`` with score 0; ties go to the first name. Null ids are kept, repeated rows
    predicted alike, other columns ignored. The model is broadcast; its size is that of
    the vocabulary for each language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_predicted(shared), "doc_id long, lang_pred string, score double")
