import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from hailgrid.llm.periodic_runs import periodic_runs, runs_of
from hailgrid.llm.queries import op11_periodic_runs

from .conftest import SF


def plain_runs(words):
    """(start, length, period) of every run, by comparing each period's neighbours."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            if len(own) >= max(6, 4 * q) and not any(own[r:] == own[:-r] for r in range(1, q)):
                out.append((i, len(own), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_runs_equal_plain_ones():
    rnd = random.Random(1)
    for _ in range(3000):
        kinds, words = rnd.choice([1, 2, 3]), []
        while len(words) < rnd.randint(0, 60):
            words += [rnd.randrange(kinds) for _ in range(rnd.randint(1, 5))] * rnd.randint(1, 7)
        assert [tuple(r) for r in runs_of(np.array(words, np.uint64)).tolist()] == plain_runs(words)


def test_long_runs_are_quick():
    assert runs_of(np.ones(300_000, np.uint64)).tolist() == [[0, 300_000, 1]]
    assert runs_of(np.tile(np.arange(500, dtype=np.uint64), 400)).tolist() == [[0, 200_000, 500]]


def test_odd_rows(spark, odd_docs, no_docs):
    runs = "a b a b a b a b a c c c c c c d d d d d"
    docs = odd_docs.select("doc_id", "text", "row", "words").unionByName(
        spark.createDataFrame([(60, runs), (61, "Go go " * 3), (62, "go\n" * 5000), (62, "go " * 5000), (63, "é " * 6)], "doc_id long, text string"), allowMissingColumns=True
    )
    found = periodic_runs(docs).collect()
    assert len(found) == docs.count()
    plain = []
    for r in docs.collect():
        words = split(r.text)
        if len(words) < 600:
            own = plain_runs(words)
            plain.append((r.doc_id, len(words), own, collapsed(words, own)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found if r.n_words < 600]
    assert sorted(got, key=repr) == sorted(plain, key=repr)
    assert {r.collapsed for r in found if r.doc_id == 62} == {"go"}
    assert periodic_runs(no_docs).count() == 0


def test_query_equals_plain_version(spark, documents):
    got = {r.doc_id: r for r in op11_periodic_runs(spark, SF).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = 0
    for r in rows:
        words, h = split(r.text), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(words) if n < 400 else [tuple(x) for x in runs_of(np.unique(words, return_inverse=True)[1].astype(np.uint64)).tolist()]
        best = min(((-length, start, q) for start, length, q in runs), default=None)
        want = (len(runs), *((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4))
        own = got[r.doc_id]
        assert (own.n_runs, own.start, own.length, own.period, own.exponent_milli) == want
        assert own.runs_sha256 == digest("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert own.collapsed_sha256 == digest(collapsed(words, runs))
        some += bool(runs)
    assert some > 5


def test_query_with_odd_ids(spark, tmp_path):
    rows = [(None, "x " * 20), (5, None), (6, ""), (7, " \t"), (7, " \t")] + [(i, "one two three") for i in range(100, 140)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_periodic_runs(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert [r.n_runs for r in got if r.doc_id is None] == [1]
    assert {r.runs_sha256 for r in got if r.doc_id in (5, 6, 7)} == {digest("")}
