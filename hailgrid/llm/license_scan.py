"""License texts and notices in documents.

Templates are fingerprinted by winnowing: of each window of consecutive shingles the
least hash is kept, so any run of ``shingle + window - 1`` template words holds a
fingerprint. An inverted index leads from fingerprint to template and position. A document's
shingles that are in the index pick the candidates, each a template on a diagonal; a
banded alignment of words then reports how much of the template is there, and where.
Alignments that follow each other in template and text, whatever stands between them or
is missing, are chained.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailgrid.llm import text as T

# Templates of one pass, so that what is broadcast is bounded; more take further passes.
PASS_BYTES = 8 << 20
REMEMBERED = 50_000
# What is put in or left out between two pieces of a template costs a word for each, and no more than this.
JOIN_COST = 6

# Short public license notices and texts.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0-notice",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("cc-by-4.0-line", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0-line", "Licensed under CC BY-SA 4.0."),
    ("gpl-2.0-line", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    ("mit-line", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. " + _WARRANTY,
    ),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


class Template(NamedTuple):
    name: str
    words: tuple[int, ...]


class Index(NamedTuple):
    """Sorted fingerprints with the template and word position of each, and a bitmap of them."""

    templates: tuple[Template, ...]
    shingle: int
    prints: np.ndarray
    template: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray


def _hashes(text: str) -> T.Words:
    data = np.frombuffer(text.encode(), np.uint8)
    return T.words(T.Block(0, data, np.array([0, len(data)])), T.is_word_byte("alnum"))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window of consecutive ones, the last if several are."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    return np.unique(len(hashes) - 1 - (views.argmin(1) + np.arange(len(views))))


def build_index(templates: list[tuple[str, str]], shingle: int, window: int) -> Index:
    """Templates with fewer words than a shingle have none and are left out."""
    kept, prints, owner, place = [], [], [], []
    for name, text in templates:
        found = _hashes(text or "")
        grams = T.grams(found, shingle)
        if len(grams):
            at = winnow(grams, window)
            prints.append(grams[at])
            owner.append(np.full(len(at), len(kept)))
            place.append(at)
            kept.append(Template(name, tuple(found.hashes.tolist())))
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (prints, owner, place)]
    order = np.argsort(flat[0], kind="stable")
    bitmap = np.zeros(1 << 16, bool)
    bitmap[(flat[0] >> np.uint64(48)).astype(np.int64)] = True
    return Index(tuple(kept), shingle, flat[0][order], flat[1][order].astype(np.int64), flat[2][order].astype(np.int64), bitmap)


def aligned(template: tuple[int, ...], words: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """(template place, word place) of the equal words in the best local alignment on diagonals ``low`` to ``high``.

    A match counts 1, another word or a gap -1. Of equal scores the one with more
    matches, then the earlier one, is taken.
    """
    none = (0, 0, 0, None)
    best = none
    before: dict[int, tuple] = {}
    for i, wanted in enumerate(template):
        row: dict[int, tuple] = {}
        left = none
        for j in range(max(0, i + low), min(len(words), i + high + 1)):
            cell = before.get(j - 1, none)
            if cell[0] <= 0:
                cell = (0, 0, -j, None)
            cell = (cell[0] + 1, cell[1] + 1, cell[2], (i, j, cell[3])) if words[j] == wanted else (cell[0] - 1, *cell[1:])
            for other in (before.get(j, none), left):
                if (other[0] - 1, other[1], other[2]) > cell[:3]:
                    cell = (other[0] - 1, *other[1:])
            left = none
            if cell[0] > 0:
                row[j] = left = cell
                if cell[:3] > best[:3]:
                    best = cell
        before = row
    pairs, link = [], best[3]
    while link:
        pairs.append(link[:2])
        link = link[2]
    return pairs[::-1]


def align(template: tuple[int, ...], words: list[int], low: int, high: int) -> tuple[int, int, int]:
    """(matched words, start, end) of the best local alignment on diagonals ``low`` to ``high``; see ``aligned``."""
    pairs = aligned(template, words, low, high)
    return (len(pairs), pairs[0][1], pairs[-1][1] + 1) if pairs else (0, 0, 0)


def _band(size: int) -> int:
    return min(16, max(1, size // 5))


class _Matches(NamedTuple):
    template: int
    matched: int
    start: int
    end: int


class _Piece(NamedTuple):
    """Equal words of a template and a text, by their places in both."""

    template: np.ndarray
    text: np.ndarray


def _pieces(template: tuple[int, ...], owner: int, words: np.ndarray, at: np.ndarray, diagonals: np.ndarray, memory: dict) -> list[_Piece]:
    """Alignments around the hits of one template at word places ``at``; by rising ``diagonals``."""
    found: list[_Piece] = []
    size, i = len(template), 0
    band = _band(size)
    while i < len(at):
        first = int(diagonals[i])
        stop = int(np.searchsorted(diagonals, first + band, side="right"))
        hits, i = np.arange(i, stop), stop
        if first >= 0 and tuple(words[first : first + size].tolist()) == template:
            found.append(_Piece(np.arange(size), np.arange(first, first + size)))
            continue
        # What stands before and after an alignment, beyond more other words than it has matches, is aligned by itself.
        parts = [(hits, 0, size, 0, len(words))]
        while parts:
            hits, from_place, to_place, from_word, to_word = parts.pop()
            low, high = int(diagonals[hits[0]]) - band, int(diagonals[hits[-1]]) + band
            begin, end = max(from_word, from_place + low), min(to_word, to_place + high)
            region = words[begin:end]
            shift = from_place - begin
            key = (owner, from_place, to_place, low + shift, high + shift, region.tobytes())
            if key not in memory:
                if len(memory) > REMEMBERED:
                    memory.clear()
                pairs = aligned(template[from_place:to_place], region.tolist(), low + shift, high + shift)
                memory[key] = np.array(pairs, np.int64).reshape(-1, 2)
            pairs = memory[key]
            if not len(pairs):
                continue
            piece = _Piece(pairs[:, 0] + from_place, pairs[:, 1] + begin)
            found.append(piece)
            places = at[hits] - diagonals[hits]
            before = hits[(at[hits] < piece.text[0]) & (places < piece.template[0])]
            after = hits[(at[hits] > piece.text[-1]) & (places > piece.template[-1])]
            if len(before):
                parts.append((before, from_place, int(piece.template[0]), from_word, int(piece.text[0])))
            if len(after):
                parts.append((after, int(piece.template[-1]) + 1, to_place, int(piece.text[-1]) + 1, to_word))
    return found


def _chained(pieces: list[_Piece]) -> list[list[tuple[int, int]]]:
    """For each piece the best chain that ends with it, as (piece, its leading words left out); the best first.

    ``pieces`` are sorted by their end in the text. Each follows the one before it in
    template and text. Words skipped between them cost one each, up to JOIN_COST; so do
    words of a piece that the template or the text alone has twice.
    """
    last_place, last_word = (np.array([p[k][-1] for p in pieces]) for k in (0, 1))
    scores, before = np.zeros(len(pieces), np.int64), [(-1, 0)] * len(pieces)
    for i, (places, words) in enumerate(pieces):
        scores[i] = len(places)
        if not i:
            continue
        by_place, by_word = np.searchsorted(places, last_place[:i], side="right"), np.searchsorted(words, last_word[:i], side="right")
        left_out = np.maximum(by_place, by_word)
        at = np.minimum(left_out, len(places) - 1)
        skipped = np.maximum(places[at] - last_place[:i], words[at] - last_word[:i]) - 1
        value = scores[:i] - np.minimum(skipped, JOIN_COST) - np.abs(by_place - by_word) + len(places) - left_out
        value[left_out == len(places)] = 0
        j = i - 1 - int(np.argmax(value[::-1]))
        if value[j] > scores[i]:
            scores[i], before[i] = value[j], (j, int(left_out[j]))
    chains = []
    for i in np.argsort(-scores, kind="stable").tolist():
        chain = []
        while i >= 0:
            j, left_out = before[i]
            chain.append((i, left_out))
            i = j
        chains.append(chain[::-1])
    return chains


def _joined(pieces: list[_Piece], owner: int, size: int, n_words: int, least: float) -> list[_Matches]:
    """Matches of at least ``least`` words that share no word of the text, from the pieces of one template."""
    found: list[_Matches] = []
    used = np.zeros(n_words, bool)

    def free(start: int, last: int) -> bool:
        return not used[start : last + 1].any()

    pieces = sorted(pieces, key=lambda p: (p.text[-1], p.text[0]))
    for p in pieces:
        if len(p.text) == size >= least and free(p.text[0], p.text[-1]):
            used[p.text[0] : p.text[-1] + 1] = True
            found.append(_Matches(owner, size, int(p.text[0]), int(p.text[-1]) + 1))
    again = True
    while again:
        again = False
        pieces = [p for p in pieces if free(p.text[0], p.text[-1])]
        # A piece worth less than a join, with no other so near that joining costs less, can't be in a chain.
        starts, ends = np.array([p.text[0] for p in pieces]), np.array([p.text[-1] for p in pieces])
        lone = np.array([len(p.text) <= JOIN_COST and len(p.text) < least for p in pieces], bool)
        near = np.searchsorted(np.sort(starts), ends + JOIN_COST, side="right") - np.searchsorted(np.sort(ends), starts - JOIN_COST, side="left")
        pieces = [p for p, drop in zip(pieces, (lone & (near < 2)).tolist(), strict=True) if not drop]
        if sum(len(p.text) for p in pieces) < least:
            break
        taken: set[int] = set()
        refused = False
        for chain in _chained(pieces):
            matched = sum(len(pieces[i].text) - left_out for i, left_out in chain)
            if matched < least:
                continue
            spans = [(int(pieces[i].text[left_out]), int(pieces[i].text[-1])) for i, left_out in chain]
            if any(i in taken for i, _ in chain) or not all(free(*s) for s in spans):
                refused = True
                continue
            taken.update(i for i, _ in chain)
            for start, last in spans:
                used[start : last + 1] = True
            found.append(_Matches(owner, matched, spans[0][0], spans[-1][1] + 1))
        again = refused and bool(taken)
    return found


def _of_text(index: Index, words: np.ndarray, at: np.ndarray, which: np.ndarray, memory: dict, min_coverage: float) -> list[_Matches]:
    """Matches in one text: hits at word places ``at`` of index entries ``which``."""
    found: list[_Matches] = []
    owners, diagonals = index.template[which], at - index.place[which]
    order = np.lexsort((at, diagonals, owners))
    owners, diagonals, at = owners[order], diagonals[order], at[order]
    there = set(words.tolist())
    for owner in np.unique(owners).tolist():
        template = index.templates[owner].words
        least = min_coverage * len(template)
        # No alignment has more words than the text and the template share.
        if sum(w in there for w in template) < least:
            continue
        mine = slice(*np.searchsorted(owners, [owner, owner + 1]))
        pieces = _pieces(template, owner, words, at[mine], diagonals[mine], memory)
        found += _joined(pieces, owner, len(template), len(words), least)
    return found


def _scan(index, min_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, memory, is_word = index.value, {}, T.is_word_byte("alnum")
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                found = T.words(block, is_word)
                grams = T.grams(found, ix.shingle)
                may = np.flatnonzero(ix.bitmap[(grams >> np.uint64(48)).astype(np.int64)])
                low = np.searchsorted(ix.prints, grams[may], side="left")
                high = np.searchsorted(ix.prints, grams[may], side="right")
                row = np.searchsorted(found.of_row, may, side="right") - 1
                inside = (high > low) & (may + ix.shingle <= found.of_row[row + 1])
                may, low, high, row = may[inside], low[inside], high[inside], row[inside]
                out = {"row": [], "name": [], "matched": [], "size": [], "start": [], "end": []}
                for own in np.unique(row).tolist():
                    first, last = int(found.of_row[own]), int(found.of_row[own + 1])
                    mine = np.flatnonzero(row == own) if len(row) < 64 else np.arange(*np.searchsorted(row, [own, own + 1]))
                    counts = high[mine] - low[mine]
                    at = np.repeat(may[mine] - first, counts)
                    which = np.repeat(low[mine] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                    for m in _of_text(ix, found.hashes[first:last], at, which, memory, min_coverage):
                        out["row"].append(block.first + own)
                        out["name"].append(ix.templates[m.template].name)
                        out["matched"].append(m.matched)
                        out["size"].append(len(ix.templates[m.template].words))
                        out["start"].append(int(found.starts[first + m.start] - block.offsets[own]))
                        out["end"].append(int(found.ends[first + m.end - 1] - block.offsets[own]))
                size = np.array(out["size"], float)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(out["row"], pa.int64())),
                        pa.array(out["name"], pa.string()),
                        pa.array(out["matched"], pa.int64()),
                        pa.array(np.array(out["matched"], float) / np.maximum(size, 1)),
                        pa.array(out["start"], pa.int64()),
                        pa.array(out["end"], pa.int64()),
                    ],
                    ["doc_id", "license", "matched_words", "coverage", "start_byte", "end_byte"],
                )

    return run


def license_spans(
    docs: DataFrame,
    templates: list[tuple[str, str]] | tuple[tuple[str, str], ...] = TEMPLATES,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    window: int = 3,
    min_coverage: float = 0.8,
) -> DataFrame:
    """``doc_id, license, matched_words, coverage, start_byte, end_byte`` of each template found in each row's whole text.

    Words are compared with A-Z in lower case. A match covers at least ``min_coverage`` of
    the template's words. Passages of any length may be put in between them, so a span can
    hold other text; a piece of up to JOIN_COST words counts only if fewer words than it has
    are put in or left out beside it. Matches of one template that share words are one. A
    text with fewer words than a shingle, and one that is null or empty, has none. Null ids are kept,
    repeated rows scanned alike, other columns ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    passes, room = [[]], PASS_BYTES
    for name, body in templates:
        if len(body or "") > room and passes[-1]:
            passes.append([])
            room = PASS_BYTES
        passes[-1].append((name, body))
        room -= len(body or "")
    schema = "doc_id long, license string, matched_words long, coverage double, start_byte long, end_byte long"
    found = None
    for part in passes:
        shared = docs.sparkSession.sparkContext.broadcast(build_index(part, shingle, window))
        own = rows.mapInArrow(_scan(shared, min_coverage), schema)
        found = own if found is None else found.union(own)
    return found
