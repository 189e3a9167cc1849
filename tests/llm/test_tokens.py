import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hailgrid.llm.packing import binary_lengths, encoder, pack
from hailgrid.llm.pieces import load_pieces
from hailgrid.llm.token_counts import automaton, count_pieces, token_counts
from tests.llm.brute import greedy_pieces

BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_ids_are_the_tokenizers(spark):
    rnd = random.Random(1)
    signs = [*"ab'stremvld  \n\t1 2!?.,é世́٣½\x1c\x85　​😀_-DS", "'re", "<|endoftext|>"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    plain = Tokenizer.from_file(BPE)
    got = [row.tolist() for _, rows in encoder(BPE).batches(pa.array([*texts, None])) for row in rows]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts] + [[]]


def test_binary_lengths():
    assert binary_lengths(1, 1024) == [1] and binary_lengths(2 * 1024 + 5, 1024) == [1024, 1024, 4, 1]
    assert all(sum(binary_lengths(n, 64)) == n for n in range(1, 300))


def test_pieces_hold_each_token_once(spark, odd_rows, odd_docs):
    rows = pack(odd_docs, BPE, limit=256).withColumn("crc", F.crc32("tokens")).collect()
    plain = Tokenizer.from_file(BPE)
    assert len({r.sequence_id for r in rows}) == len(rows)
    by_doc = {}
    for r in rows:
        ids = np.frombuffer(r.tokens, "<u4").tolist()
        assert len(ids) == r.length == r.bucket and r.length & (r.length - 1) == 0 and r.length <= 256 and r.offset == 0
        assert r.crc == zlib.crc32(r.tokens)
        by_doc.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
    for doc_id in (40, 41, 42, 45, 48, 51, None):
        text = dict(odd_rows).get(doc_id) if doc_id else "no id here but some words " * 12
        want = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[doc_id])
        assert [i for _, ids, _ in own for i in ids] == want and {n for *_, n in own} == {len(want)}
    assert sum(n for _, _, n in by_doc[49] if n) and len({s for s, *_ in by_doc[49]}) * 3 == len(by_doc[49])


def test_a_limit_is_a_power_of_two(odd_docs):
    with pytest.raises(ValueError):
        pack(odd_docs, BPE, limit=1000)


def test_counts_are_greedy(spark, odd_rows, odd_docs, documents):
    pieces = load_pieces(RANKS)
    for docs in (odd_docs, documents):
        texts = {}
        for r in docs.select("doc_id", "text").collect():
            texts[r.doc_id] = r.text
        got = {r.doc_id: r.n_tokens for r in token_counts(docs, RANKS).collect()}
        assert got == {d: greedy_pieces(t, pieces) for d, t in texts.items()}


def test_long_words_are_matched_alike():
    a, pieces = automaton(RANKS), load_pieces(RANKS)
    text = ("antidisestablishment" * 40).encode()
    data = np.frombuffer(text, np.uint8)
    assert count_pieces(a, data, np.array([0]), np.array([len(data)])).tolist() == [greedy_pieces(text.decode(), pieces)]


def test_empty_table(no_docs):
    assert pack(no_docs, BPE).count() == 0 and token_counts(no_docs, RANKS).count() == 0
