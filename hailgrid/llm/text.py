"""Vectorised work on whole Arrow columns of text: blocks, words, hashes.

A column is handled in blocks of about a megabyte of UTF-8, so memory follows the
block and the longest single text, not the batch. All hashes are functions of the
bytes alone: the same on every executor and in every retry.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


class Block(NamedTuple):
    """Some consecutive rows: ``data[offsets[i]:offsets[i + 1]]`` is the text of row ``first + i``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    _, places, values = column.buffers()
    ends = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1)
        yield Block(row, whole[ends[row] : ends[last]], ends[row : last + 1] - ends[row])
        row = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS, _INVERSES = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        _POWERS[0] = _INVERSES[0] = 1
        np.cumprod(_POWERS, out=_POWERS)
        np.cumprod(_INVERSES, out=_INVERSES)
    return _POWERS, _INVERSES


@lru_cache(maxsize=1)
def _code_values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * _U(_BASE))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each range of bytes or code points; with ``lower``, of bytes with A-Z in lower case."""
    powers, inverses = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    if data.dtype == np.uint8:
        values = (_BYTE_VALUES[LOWER] if lower else _BYTE_VALUES)[data]
    else:
        values = _code_values()[data]
    np.cumsum(values * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` bytes, which end with their text; and per text where its runs begin."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside & edge[:n]
    starts[1:] |= inside[1:] & ~inside[:-1]
    stops = inside & edge[1:]
    stops[:-1] |= inside[:-1] & ~inside[1:]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    of_row: np.ndarray
    hashes: np.ndarray


def words(block: Block, is_word: np.ndarray) -> Words:
    """Runs of the bytes that ``is_word`` marks, hashed with A-Z in lower case; ``of_row[i]`` is the first of row i."""
    starts, ends, of_row = spans_of(is_word[block.data], block.offsets)
    return Words(starts, ends, of_row, hash_ranges(block.data, starts, ends, lower=True))


def grams(found: Words, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words by its first word; runs over a text's end are to be left out."""
    count = max(0, len(found.hashes) - n + 1)
    out = np.full(count, 0x2545F4914F6CDD1D, np.uint64)
    for i in range(n):
        out = mix(out * _U(_BASE) + found.hashes[i : i + count])
    return out


def whole_gram(hashes: np.ndarray) -> int:
    """The hash of a text with fewer words than a shingle has; differs from that of any other length."""
    out = 0x2545F4914F6CDD1D
    for h in hashes.tolist():
        out = int(mix(np.array([(out * _BASE + h) & _MASK], np.uint64))[0])
    return out


def is_word_byte(pattern: str) -> np.ndarray:
    """Which bytes a word holds: ``space`` for all but white space, ``alnum`` for letters, digits and non-ASCII."""
    out = np.ones(256, bool)
    if pattern == "space":
        out[[0x20, *range(0x09, 0x0E)]] = False
    elif pattern == "alnum":
        out[:128] = [chr(i).isalnum() for i in range(128)]
    else:
        raise ValueError(pattern)
    return out


class WordTable:
    """What a worker remembers of words by their hash: a number from 0 up for each, in an open hash table.

    ``limit`` bounds the words; ``find`` forgets all beforehand once it is passed, and
    whoever keeps arrays by number then starts them anew (``generation`` tells).
    """

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.generation = limit, 0
        self._clear(1 << 16)

    def _clear(self, size: int) -> None:
        self.keys, self.numbers, self.count = np.zeros(size, np.uint64), np.zeros(size, np.int32), 0

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per hash its slot, or the free one where it belongs, and whether it is there."""
        mask = np.uint64(len(self.keys) - 1)
        slots = (hashes & mask).astype(np.int64)
        held = self.keys[slots]
        there = held == hashes
        on = np.flatnonzero(~there & (held != 0))
        while len(on):
            slots[on] = (slots[on] + 1) & int(mask)
            held = self.keys[slots[on]]
            same = held == hashes[on]
            there[on[same]] = True
            on = on[~same & (held != 0)]
        return slots, there

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        while len(hashes):
            slots, _ = self._slots(hashes)
            self.keys[slots] = hashes
            won = self.keys[slots] == hashes
            self.numbers[slots[won]] = numbers[won]
            hashes, numbers = hashes[~won], numbers[~won]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each hash; and for the new ones, in order of number, the place of one occurrence."""
        hashes = np.where(hashes == 0, _U(1), hashes)
        if self.count > self.limit:
            self._clear(1 << 16)
            self.generation += 1
        slots, there = self._slots(hashes)
        if there.all():
            return self.numbers[slots], np.zeros(0, np.int64)
        missing = np.flatnonzero(~there)
        new, first = np.unique(hashes[missing], return_index=True)
        if 2 * (self.count + len(new)) > len(self.keys):
            old, numbers = self.keys[self.keys != 0], self.numbers[self.keys != 0]
            count = self.count
            self._clear(1 << (4 * (count + len(new)) - 1).bit_length())
            self.count = count
            self._insert(old, numbers)
        self._insert(new, np.arange(self.count, self.count + len(new), dtype=np.int32))
        self.count += len(new)
        slots, _ = self._slots(hashes)
        return self.numbers[slots], missing[first]


def text_key(doc_id: str, text: str) -> Column:
    """A hash of id and text by which a row is found again; copies under other ids get other keys."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.col(text).isNull())
