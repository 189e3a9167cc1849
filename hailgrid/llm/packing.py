"""Packing of tokenised documents into sequences of power-of-two length.

The token count of a document is written in binary: as many pieces of ``limit`` tokens as
fit, then one piece for each power of two in the rest. Pieces of equal length form a
bucket, from which batches are drawn. A piece is a sequence of its own, so no sequence
crosses documents, and none is padded.

Tokens come from a byte-level BPE vocabulary. Its pre-tokens are found for a whole block
of texts at once; each distinct pre-token is merged with the tokenizer's vocabulary and
its ids are remembered by the worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailgrid.llm import text as T

# Distinct pre-tokens remembered by a worker; beyond it the memory starts anew.
REMEMBERED = 1_000_000
BLOCK = 2 << 20
LETTER, NUMBER, SPACE, OTHER = range(4)
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Letter, number, white space or other, by code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "-" for c in range(0x110000))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    # Python's white space has four separators that the pattern's hasn't.
    out[0x1C:0x20] = OTHER
    return out


def pre_token_starts(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the texts in ``codes`` (code points; a text begins at each of ``begins``) start.

    They are: an apostrophe with s, t, re, ve, m, ll or d; a run of letters, of numbers or
    of other signs, with the blank before it; white space, less the character before
    the next run.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[codes]
    fresh = np.zeros(n + 1, bool)
    fresh[begins] = True
    fresh[n] = True
    change = fresh[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    blank = codes == 0x20
    before = np.zeros(n, bool)
    before[1:] = blank[:-1] & ~fresh[1:n]
    starts = change & ~(before & (kind != SPACE))
    # White space before a run: its last character stands alone or goes with the run.
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~fresh[1:n]
    starts |= last
    quotes = np.flatnonzero((codes == 0x27) & change & ~before)
    for letters in _CONTRACTIONS:
        size = len(letters)
        at = quotes[quotes + size < n]
        for i, letter in enumerate(letters, 1):
            at = at[(codes[at + i] == ord(letter)) & ~fresh[at + i]]
        starts[at + 1] = False
        after = at + size + 1
        starts[after[(after < n)]] |= (kind[after[after < n]] == LETTER) & ~fresh[after[after < n]]
    return np.flatnonzero(starts)


def _merger(tokenizer):
    """The merges of a byte-level BPE on the bytes of one pre-token; as the tokenizer itself, but faster on rare words."""
    import tiktoken

    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = tokenizer.get_added_tokens_decoder()
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in tokenizer.get_vocab(with_added_tokens=False).items() if i not in special}
    return tiktoken.Encoding("pieces", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Encoder:
    """Token ids of many texts by one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = _merger(self.tokenizer)
        self.words = T.WordTable(REMEMBERED)
        self._clear()

    def _clear(self) -> None:
        self.generation, self.count, self.used = self.words.generation, 0, 0
        self.flat, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _remember(self, pieces: list[str]) -> None:
        ids = [self.merge(p.encode()) for p in pieces]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        count, total = self.count + len(ids), self.used + int(sizes.sum())
        for name, need in (("start", count), ("size", count), ("flat", total)):
            if (own := getattr(self, name)).size < need:
                setattr(self, name, np.concatenate((own, np.zeros(max(need - own.size, own.size), own.dtype))))
        self.size[self.count : count] = sizes
        self.start[self.count : count] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : total] = np.fromiter((i for own in ids for i in own), np.uint32, total - self.used)
        self.count, self.used = count, total

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and per text where its ids begin, with the end."""
        joined = "".join(texts)
        ends = np.cumsum([0, *map(len, texts)])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = pre_token_starts(codes, ends[:-1][ends[:-1] < len(codes)])
        stops = np.append(starts[1:], len(codes))
        numbers, new = self.words.find(T.hash_ranges(codes, starts, stops))
        if self.generation != self.words.generation:
            self._clear()
        if len(new):
            self._remember([joined[s:e] for s, e in zip(starts[new].tolist(), stops[new].tolist(), strict=True)])
        sizes = self.size[numbers]
        begin = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(self.start[numbers] - begin[:-1], sizes) + np.arange(begin[-1])]
        return ids, begin[np.searchsorted(starts, ends)]

    def batches(self, column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first row, ids of each row) for blocks of a column; null is empty."""
        for block in T.blocks(column, BLOCK):
            data = block.data.tobytes()
            texts = [data[a:b].decode(errors="replace") for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]
            # A text with a special token's own characters is left to the tokenizer as a whole.
            odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
            plain = texts if not odd else ["" if i in set(odd) else t for i, t in enumerate(texts)]
            ids, begin = self.block(plain)
            rows = [ids[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            for i in odd:
                rows[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            yield block.first, rows


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def binary_lengths(count: int, limit: int) -> list[int]:
    """Piece lengths, longest first: full pieces, then the powers of two of the rest."""
    rest = count % limit
    return [limit] * (count // limit) + [1 << b for b in range(limit.bit_length() - 2, -1, -1) if rest >> b & 1]


def _pieces(path: str, limit: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            ids_of = batch.column("doc_id")
            for first, rows in encode.batches(batch.column("text")):
                own, start, length, total, tokens = [], [], [], [], []
                for i, row in enumerate(rows, first):
                    ids = np.append(row, np.uint32(end_id))
                    at = 0
                    for n in binary_lengths(len(ids), limit):
                        own.append(i)
                        start.append(at)
                        length.append(n)
                        total.append(len(ids))
                        tokens.append(ids[at : at + n].astype("<u4").tobytes())
                        at += n
                yield pa.RecordBatch.from_arrays(
                    [ids_of.take(pa.array(own, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(tokens, pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "tokens"],
                )

    return run


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all rows: ``doc_id, start, length, doc_tokens, tokens, bucket, sequence_id, offset``.

    ``tokens`` holds the ids as little-endian unsigned 32-bit numbers. Each row's ids, with
    ``end_id`` at the end, are cut without gaps into pieces of power-of-two length, at
    most ``limit`` (itself a power of two). A piece is a sequence: ``sequence_id`` is
    unique, ``offset`` is 0, and ``bucket`` is the length by which sequences are batched.
    Null and empty texts have one piece, the end. Null ids are kept, repeated rows packed
    again, other columns ignored; an empty table gives no rows.
    """
    if limit & (limit - 1) or limit < 2:
        raise ValueError("limit must be a power of two")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = rows.mapInArrow(_pieces(tokenizer, limit, end_id), "doc_id long, start long, length long, doc_tokens long, tokens binary")
    return pieces.select(
        "*", F.col("length").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

