"""A byte-level vocabulary as a trie with dense transitions."""

from __future__ import annotations

import base64
from functools import lru_cache
from typing import NamedTuple

import numpy as np


class Trie(NamedTuple):
    """``next[inner[node], byte]`` is a child or -1; ``piece[node]`` is a piece's number or -1. Node 0 is the root."""

    next: np.ndarray
    inner: np.ndarray
    piece: np.ndarray
    parent: np.ndarray
    byte: np.ndarray
    size: int


def load_pieces(path: str) -> list[bytes]:
    """The pieces of a vocabulary file with a base64 piece and its rank on each line; all single bytes are added."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, lines))
    pieces = [piece for _, piece in ranked]
    known = set(pieces)
    return pieces + [bytes([b]) for b in range(256) if bytes([b]) not in known]


@lru_cache(maxsize=4)
def trie(path: str, longest: int | None = None) -> Trie:
    """The trie of a vocabulary, by breadth; without pieces longer than ``longest`` bytes."""
    pieces = load_pieces(path)
    children: list[dict[int, int]] = [{}]
    piece_of, parent, byte = [-1], [0], [0]
    for number, piece in sorted(enumerate(pieces), key=lambda p: len(p[1])):
        if longest and len(piece) > longest:
            continue
        node = 0
        for b in piece:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                piece_of.append(-1)
                parent.append(node)
                byte.append(b)
            node = children[node][b]
        piece_of[node] = number
    # Leaves share one row without transitions.
    inner = np.zeros(len(children), np.int32)
    with_children = [i for i, own in enumerate(children) if own]
    inner[with_children] = np.arange(1, len(with_children) + 1)
    table = np.full((len(with_children) + 1, 256), -1, np.int32)
    for node in with_children:
        table[inner[node], list(children[node])] = list(children[node].values())
    return Trie(table, inner, np.array(piece_of, np.int32), np.array(parent, np.int32), np.array(byte, np.uint8), len(pieces))
