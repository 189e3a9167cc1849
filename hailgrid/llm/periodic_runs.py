"""Periodic runs of words: stretches that repeat with a smallest period, four times or more.

Descending-LCP Kruskal on each text's own suffixes:

1. Words become ranks; doubling the compared length ranks the suffixes of all texts of a
   block at once. A text's words are symbols of their own, so no suffix ever equals one of
   another text, and only suffixes that still share their beginning go on.
2. Neighbours in suffix order are edges, weighted by their common prefix (LCP). Taken by
   descending weight, union-find unites the classes of suffixes that share that much.
   Each class holds its positions in order; the smaller goes into the larger one.
3. Two positions that become neighbours when classes meet, at a distance ``d`` within the
   LCP ``l``, agree on ``l`` words that overlap: they seed a run of period ``d`` and length
   ``d + l``. It is a run's seed if no word before extends it.

Every run is found, once: of a run with smallest period q that is at least 3 q long, the
first position and the one q later have nothing of their class between them when they
meet, as that would be a smaller period; and a distance that isn't the smallest period
has such a position between. Edges shorter than any run needs are never united.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hailgrid.llm import text as T

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
RUN_TYPE = "array<struct<start:long,length:long,period:long>>"


class _Suffixes:
    """Suffix ranks of a string of symbols, kept for every doubled length as long as any two are equal."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.n = n
        order = np.argsort(symbols, kind="stable")
        ranks, live = self._regroup(np.arange(n), order, symbols[order], None)
        self.levels = [ranks]
        length = 1
        while len(live):
            # Beyond the end comes before all others.
            follow = np.where(live + length < n, ranks[np.minimum(live + length, n - 1)], -1)
            order = np.lexsort((follow, ranks[live]))
            ranks, live = self._regroup(live, order, follow[order], ranks)
            self.levels.append(ranks)
            length *= 2
        self.ranks = ranks

    @staticmethod
    def _regroup(live: np.ndarray, order: np.ndarray, keys: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """New ranks (place of the first of equals) and the positions that still have equals."""
        rows = live[order]
        new = np.ones(len(rows), bool)
        if len(rows):
            new[1:] = keys[1:] != keys[:-1]
            if before is not None:
                new[1:] |= before[rows[1:]] != before[rows[:-1]]
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        if before is None:
            ranks = np.empty(len(rows), np.int32)
            ranks[rows] = first[of]
        else:
            ranks = before.copy()
            # A group's rows stand at its rank and after it.
            group = np.ones(len(rows), bool)
            group[1:] = before[rows[1:]] != before[rows[:-1]]
            start = np.flatnonzero(group)
            ranks[rows] = before[rows] + (first[of] - start[np.cumsum(group) - 1])
        sizes = np.diff(np.append(first, len(rows)))
        return ranks, np.sort(rows[sizes[of] > 1])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b`` (no pair the same)."""
        length = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            x, y = a + length, b + length
            inside = (x < self.n) & (y < self.n)
            ranks = self.levels[level]
            equal = inside & (ranks[np.minimum(x, self.n - 1)] == ranks[np.minimum(y, self.n - 1)])
            length[equal] += 1 << level
        return length

    def edges(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbours in suffix order (a, b) with a common prefix of ``least`` words or more, and its length."""
        level = least.bit_length() - 1
        if level >= len(self.levels):
            return (np.zeros(0, np.int64),) * 3
        # Suffixes that have an equal at that length only; others share less with any.
        ranks = self.levels[level]
        sizes = np.bincount(ranks, minlength=self.n)
        rows = np.flatnonzero(sizes[ranks] > 1)
        rows = rows[np.argsort(self.ranks[rows], kind="stable")]
        a, b = rows[:-1], rows[1:]
        near = ranks[a] == ranks[b]
        a, b = a[near], b[near]
        common = self.common(a, b)
        long = common >= least
        return a[long], b[long], common[long]


def _hopeful(a: np.ndarray, b: np.ndarray, common: np.ndarray, share: int) -> np.ndarray:
    """Which edges lie in a chain that can hold a run: two of its positions are near enough for its longest prefix."""
    if not len(a):
        return np.zeros(0, bool)
    chain = np.cumsum(np.append(0, (a[1:] != b[:-1]).astype(np.int64)))
    last = np.append(chain[1:] != chain[:-1], True)
    # A chain's positions: the first of each edge and the second of its last one.
    of, place = np.concatenate([chain, chain[last]]), np.concatenate([a, b[last]])
    order = np.lexsort((place, of))
    of, place = of[order], place[order]
    gap = np.where(of[1:] == of[:-1], place[1:] - place[:-1], np.iinfo(np.int64).max)
    least = np.full(chain[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, of[1:], gap)
    most = np.zeros(chain[-1] + 1, np.int64)
    np.maximum.at(most, chain, common)
    return (least <= most // share)[chain]


def _seeds(a: list[int], b: list[int], common: list[int], share: int) -> list[tuple[int, int, int]]:
    """(position, distance, LCP) of the neighbours that arise at a distance of at most LCP / ``share``.

    Edges come by descending LCP.
    """
    root: dict[int, int] = {}
    sets: dict[int, list[int]] = {}
    found = []

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x], x = top, up
        return top

    for x, y, l in zip(a, b, common, strict=True):
        x, y = find(x), find(y)
        most = l // share
        large, small = sets.pop(x, None) or [x], sets.pop(y, None) or [y]
        if len(large) < len(small):
            x, y, large, small = y, x, small, large
        root[y] = x
        size = len(small)
        for k, p in enumerate(small):
            at = bisect_left(large, p)
            # New neighbours only: those of the same class were neighbours before.
            if at and p - large[at - 1] <= most and (not k or small[k - 1] < large[at - 1]):
                found.append((large[at - 1], p - large[at - 1], l))
            if at < len(large) and large[at] - p <= most and (k + 1 == size or small[k + 1] > large[at]):
                found.append((p, large[at] - p, l))
        if 16 * size < len(large):
            for p in small:
                insort(large, p)
        else:
            large += small
            large.sort()
        sets[x] = large
    return found


def runs_of(symbols: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (start, length, period), by start and period, of the runs of a string of symbols.

    A run is a stretch of smallest period q and at least ``least_length`` and
    ``least_exponent * q`` symbols that neither neighbour extends; ``least_exponent`` is 4 or more.
    """
    none = np.zeros((0, 3), np.int64)
    share = least_exponent - 1
    # Of period 1 a run shares all but one word with itself; longer periods share three of them.
    least = min(max(least_length - 1, share), max(least_length - 2, 2 * share)) if least_length > 1 else share
    if len(symbols) <= least:
        return none
    suffixes = _Suffixes(symbols)
    a, b, common = suffixes.edges(least)
    keep = _hopeful(a, b, common, share)
    a, b, common = a[keep], b[keep], common[keep]
    order = np.argsort(-common, kind="stable")
    found = np.array(_seeds(a[order].tolist(), b[order].tolist(), common[order].tolist(), share), np.int64).reshape(-1, 3)
    if not len(found):
        return none
    at, period, shared = found.T
    longer = (at > 0) & (symbols[np.maximum(at, 1) - 1] == symbols[np.maximum(at + period, 1) - 1])
    keep = ~longer & (shared + period >= least_length)
    out = np.stack([at, shared + period, period], axis=1)[keep]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    is_word = T.is_word_byte("space")
    for batch in batches:
        for block in T.blocks(batch.column("text")):
            starts, ends, of_row = T.spans_of(is_word[block.data], block.offsets)
            hashes = T.hash_ranges(block.data, starts, ends)
            # A text's words are symbols of their own.
            row = np.repeat(np.arange(block.rows, dtype=np.uint64), np.diff(of_row))
            found = runs_of(T.mix(hashes + T.mix(row + np.uint64(1))))
            bounds = np.searchsorted(found[:, 0], of_row)
            local = found[:, 0] - of_row[np.searchsorted(of_row, found[:, 0], side="right") - 1]
            # Words that some run covers after its first period.
            covers = np.zeros(len(starts) + 1, np.int64)
            np.add.at(covers, found[:, 0] + found[:, 2], 1)
            np.add.at(covers, found[:, 0] + found[:, 1], -1)
            kept = np.cumsum(covers)[:-1] == 0
            collapsed, data = [], block.data.tobytes()
            for i in range(block.rows):
                words = data[block.offsets[i] : block.offsets[i + 1]].split()
                if bounds[i] < bounds[i + 1]:
                    words = [w for w, k in zip(words, kept[of_row[i] : of_row[i + 1]].tolist(), strict=True) if k]
                collapsed.append(b" ".join(words))
            runs = pa.StructArray.from_arrays(
                [pa.array(local), pa.array(found[:, 1]), pa.array(found[:, 2])], ["start", "length", "period"]
            )
            part = batch.slice(block.first, block.rows)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(of_row).astype(np.int64)),
                    pa.ListArray.from_arrays(bounds.astype(np.int32), runs),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each row of ``docs``.

    Words are runs of other characters than blanks and the controls from tab to
    carriage return, numbered from 0 and compared byte by byte (by 64-bit hashes). A run is a stretch with
    smallest period q, six words and 4 q or more long, that no neighbouring word extends; ``runs`` has
    (start, length, period) of each, by start and period. ``collapsed`` is the text's words joined
    by one blank, without those that any run holds after its first period.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Each row is
    judged alone: repeated rows and ids give a row each, a null id stays null. Extra columns are
    ignored; an empty table gives no rows. Memory follows a block of a megabyte or the longest text.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(_found, f"doc_id long, n_words long, runs {RUN_TYPE}, collapsed string")


def planted(doc_id: str, text: str) -> Column:
    """The text with a period of its own in every tenth document, by the checksum of its id.

    With h = crc32 of the decimal id and g = floor(h / 10): where h % 10 is 0 and there are n > 0
    words, each word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). Other texts, and those without id, stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def changed(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        rest = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), rest), " "))

    # As an array of one the words are computed once.
    altered = F.get(F.transform(F.array(words), changed), F.lit(0))
    return F.when(h % 10 == 0, F.coalesce(altered, F.col(text))).otherwise(F.col(text))
