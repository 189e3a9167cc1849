"""Token counts by greedy longest match, in time linear in the text.

The vocabulary is a trie with failure links. Each node has a number of popped pieces:
how many the greedy match has fixed when no longer piece can follow, before it goes on
at the node of the failure link with what is left. Counting needs only these numbers;
no piece is ever built.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailgrid.llm import text as T
from hailgrid.llm.pieces import Trie, trie

REMEMBERED = 1_000_000
# Longer words are matched one by one instead of side by side.
SIDE_BY_SIDE = 200


class Automaton(NamedTuple):
    trie: Trie
    fail: np.ndarray
    popped: np.ndarray
    rest: np.ndarray


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """Failure links, popped pieces, and the pieces left at a word's end, by node."""
    t = trie(path)
    count = len(t.piece)
    following, inner, piece = t.next, t.inner.tolist(), t.piece.tolist()
    parent, byte = t.parent.tolist(), t.byte.tolist()
    fail, popped, rest = [0] * count, [0] * count, [0] * count
    depth = [0] * count
    for node in range(1, count):
        depth[node] = depth[parent[node]] + 1
    for node in sorted(range(1, count), key=depth.__getitem__):
        if piece[node] >= 0:
            popped[node] = 1
        else:
            # Fail as the parent does, until its remainder can be followed by this byte. At
            # the root every byte can, as all single bytes are pieces.
            at, n = fail[parent[node]], popped[parent[node]]
            while (to := int(following[inner[at], byte[node]])) < 0:
                n += popped[at]
                at = fail[at]
            fail[node], popped[node] = to, n
        rest[node] = popped[node] + rest[fail[node]]
    return Automaton(t, *(np.array(x, np.int32) for x in (fail, popped, rest)))


def _count_one(a: Automaton, data: bytes) -> int:
    following, inner = a.trie.next, a.trie.inner
    node = total = 0
    for b in data:
        while (to := following[inner[node], b]) < 0:
            total += int(a.popped[node])
            node = a.fail[node]
        node = to
    return total + int(a.rest[node])


def count_pieces(a: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of pieces of each byte range, matched greedily."""
    size = ends - starts
    total = np.zeros(len(starts), np.int64)
    for i in np.flatnonzero(size > SIDE_BY_SIDE).tolist():
        total[i] = _count_one(a, data[starts[i] : ends[i]].tobytes())
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= SIDE_BY_SIDE]
    node = np.zeros(len(order), np.int32)
    counted = np.zeros(len(order), np.int64)
    lengths = size[order]
    for step in range(int(lengths[0]) if len(order) else 0):
        active = int(np.searchsorted(-lengths, -step, side="left"))
        byte = data[starts[order[:active]] + step]
        to = a.trie.next[a.trie.inner[node[:active]], byte]
        stuck = np.flatnonzero(to < 0)
        while len(stuck):
            counted[stuck] += a.popped[node[stuck]]
            node[stuck] = a.fail[node[stuck]]
            to[stuck] = a.trie.next[a.trie.inner[node[stuck]], byte[stuck]]
            stuck = stuck[to[stuck] < 0]
        node[:active] = to
    total[order] = counted + a.rest[node]
    return total


def pre_words(block: T.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows' first of the pieces that no token crosses: words with the blank before them, and other white space."""
    data, n = block.data, len(block.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(block.rows + 1, np.int64)
    word = T.is_word_byte("space")[data]
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    starts = edge[:n].copy()
    starts[1:] |= word[1:] != word[:-1]
    # The blank before a word goes with it.
    follows = np.flatnonzero(word[1:] & ~word[:-1] & (data[:-1] == 0x20) & ~edge[1:n]) + 1
    starts[follows] = False
    starts[follows - 1] = True
    begin = np.flatnonzero(starts)
    return begin, np.append(begin[1:], n), np.searchsorted(begin, block.offsets)


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        words, generation, known = T.WordTable(REMEMBERED), 0, np.zeros(0, np.int64)
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                starts, ends, of_row = pre_words(block)
                numbers, new = words.find(T.hash_ranges(block.data, starts, ends))
                if generation != words.generation:
                    generation, known = words.generation, known[:0]
                known = np.concatenate((known, count_pieces(a, block.data, starts[new], ends[new])))
                sums = np.concatenate(([0], np.cumsum(known[numbers])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, block.rows), pa.array(np.diff(block.offsets), pa.int64()), pa.array(sums[of_row[1:]] - sums[of_row[:-1]])],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    return run


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of each row: the greedy longest-match pieces of its whole text.

    Pieces don't cross words (runs without white space, with the one blank before them).
    Null and empty texts have none. Null ids are kept, repeated rows counted alike, other
    columns ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_counts(vocabulary), "doc_id long, n_bytes long, n_tokens long")
