import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hailgrid.llm import ranked_search as rs
from hailgrid.llm.queries import op13_ranked_search

from .conftest import SF


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] by scoring every document for every item."""
    own = [(d, c, sum(c.values())) for d, t in docs if (c := Counter(terms(t)))]
    total, n_docs = sum(n for *_, n in own), len(own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if df[t]}
        scores = []
        for d, c, n in own:
            m = 100 - 90 + (90 * n * n_docs) // total
            score = sum(w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, w in weights.items() if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out


def key(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(8)
    vocabulary = ["w%d" % i for i in range(300)]

    def text(n):
        return " ".join(vocabulary[min(299, int(rnd.expovariate(0.02)))] for _ in range(n))

    return rnd, text


def test_equals_plain_ranking(spark, words, monkeypatch):
    rnd, text = words
    docs = [(i, text(rnd.randint(1, 60))) for i in rnd.sample(range(5000), 1500)]
    docs += [(5000 + i, t) for i, (_, t) in enumerate(docs[:40])]  # ties
    items = [("i%d" % i, text(rnd.randint(1, 25))) for i in range(40)]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")
    want = key(plain(docs, items))
    assert key(rs.search(rs.build_index(frame), asked).collect()) == want
    # Several searches, and the index read by its own.
    assert key(rs.search(rs.build_index(frame), asked, search_terms=50).collect()) == want


def test_blocks_are_rejected_before_they_are_decompressed(words):
    rnd, text = words
    rs_docs = [text(rnd.randint(1, 60)) for _ in range(6000)]
    rows = rs.T.blocks(pa.array(rs_docs), limit=1 << 24)
    shard = rs._Shard()
    for block in rows:
        shard.add(pa.array(range(block.first, block.first + block.rows)), block)
    batch = shard.batch(3)
    lengths = np.array(batch.column("lengths")[0].values, np.int64)
    n_words = int(lengths.sum())

    def norm_of(n):
        return 10 + (90 * n * len(lengths)) // n_words

    of = {t: i for i, t in enumerate(batch.column("term").to_pylist())}
    full = decoded = 0
    for _ in range(30):
        asked = set(terms(text(12)))
        lists = []
        for t in asked:
            if (i := of.get(t.encode())) is not None:
                weight = math.floor(1000 * math.log((2 * len(lengths) + 2) / (2 * batch.column("df")[i].as_py() + 1)))
                lists.append(rs._Postings(weight, batch.column("blocks")[i].values, norm_of(lengths), norm_of))
        best = rs._Best(10, np.arange(len(lengths)))
        rs._search_shard(lists, len(lengths), best, step=512)
        full += sum(len(x.there) for x in lists)
        decoded += sum(int(x.there.sum()) for x in lists)
        gains = np.zeros(len(lengths), np.int64)
        for x in lists:
            # The bound of a block holds for every posting.
            x.need(np.arange(len(x.last)))
            gains[x.docs] += x.gains
            assert (np.maximum.reduceat(x.gains, x.first[:-1]) <= x.bound).all()
        order = np.lexsort((np.arange(len(gains)), -gains))[:10]
        assert best.docs.tolist() == order.tolist()
        assert best.scores.tolist() == gains[order].tolist()
    assert decoded < full


def test_odd_rows(spark, odd_docs, no_docs):
    items = [("a", "one two three"), ("a", "one two three"), ("a", "日本語 ONE"), (None, "id words"), ("b", None), ("c", " . "), ("d", "nowhere"), ("e", "x" * 700)]
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    asked = spark.createDataFrame(items, "item_id string, text string").withColumn("item", F.lit(1)).withColumn("term", F.lit("x"))
    assert key(rs.search(rs.build_index(odd_docs), asked).collect()) == key(plain(docs, items))
    assert rs.search(rs.build_index(no_docs), asked).collect() == []
    assert rs.search(rs.build_index(odd_docs), asked.limit(0)).collect() == []


def test_shards_and_widths(spark, monkeypatch):
    docs = [(i, "rare " * (i % 700 == 3) + "common " * (1 + i % 5) + "many " * (300 if i == 40 else 0) + "w%d" % (i % 9)) for i in range(3000)]
    docs.append((9000, "deep " * 70_000))
    items = [(1, "rare many w3"), (2, "common"), (3, "deep w1 common many")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = rs.build_index(frame)
    assert key(rs.search(index, spark.createDataFrame(items, "item_id int, text string")).collect()) == key(plain(docs, items))


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert key(op13_ranked_search(spark, SF).collect()) == key(plain(docs, items))
