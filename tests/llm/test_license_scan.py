import random

import numpy as np
from pyspark.sql import functions as F

from hailgrid.llm.license_scan import TEMPLATES, _hashes, align, license_spans, winnow


def best_local(a, b):
    """The best local alignment of two word lists, without a band."""
    score = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            score[i + 1, j + 1] = max(0, score[i, j] + (1 if a[i] == b[j] else -1), score[i, j + 1] - 1, score[i + 1, j] - 1)
    return int(score.max())


def test_winnowing_leaves_no_run_without_a_fingerprint():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 50, 300).astype(np.uint64)
    places = winnow(hashes, 5)
    assert all(((places >= i) & (places < i + 5)).any() for i in range(296))


def test_alignment_matches_the_full_one():
    rnd = random.Random(4)
    for _ in range(100):
        a = [rnd.randint(0, 60) for _ in range(20)]
        b = [w for w in a if rnd.random() > 0.1]
        b[5:5] = [99]
        matched, start, end = align(tuple(a), b, -20, 20)
        wrong = best_local(a, b)
        assert end > start >= 0 and matched >= wrong


def test_exact_edited_and_absent_templates(spark):
    mit = dict(TEMPLATES)["mit"]
    words = mit.split()
    edited = " ".join(words[:20] + ["new", "words"] + words[20:60] + words[62:])
    rows = [
        (1, "Intro text. " + mit + " More text."),
        (2, "some words\n" + edited.upper()),
        (3, " ".join(words[:40])),
        (4, None),
        (5, ""),
        (6, "All rights reserved. All rights reserved!"),
        (None, "é Licensed under CC BY-NC 4.0."),
        (8, "rights"),
        (8, "Released under the MIT License."),
        (8, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x"))
    got = license_spans(docs).collect()
    found = sorted((r.doc_id or 0, r.license, round(r.coverage, 2)) for r in got)
    assert (1, "mit", 1.0) in found
    assert any(d == 2 and n == "mit" and 0.9 < c < 1 for d, n, c in found)
    assert not any(d in (3, 4, 5) for d, _, _ in found)
    assert [f for f in found if f[0] == 6] == [(6, "all-rights-reserved", 1.0)] * 2
    assert (0, "cc-by-nc-4.0-line", 1.0) in found
    assert [f for f in found if f[0] == 8] == [(8, "mit-line", 1.0)] * 2
    texts = dict((d, t) for d, t in rows if d in (1, 2))
    for r in got:
        if r.doc_id in texts and r.license == "mit":
            span = texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode()
            assert span.lower().startswith("permission is hereby") and span.lower().endswith("in the software")


def test_long_insertions_and_deletions(spark):
    words = dict(TEMPLATES)["mit"].split()
    n = len(words)
    other = [f"other{i}" for i in range(2000)]
    texts = {
        "insertion": (words[: n // 2] + other[:25] + words[n // 2 :], n),
        "deletion": (words[: n // 2 - 12] + words[n // 2 + 13 :], n - 25),
        "two insertions": (words[:50] + other[:40] + words[50:100] + other[40:65] + words[100:], n),
        "page between": (words[:60] + other + words[60:], n),
        "replaced near the start": (words[:15] + other[:25] + words[40:], n - 25),
        "too much left out": (words[:60] + words[100:], None),
    }
    docs = spark.createDataFrame([(i, " ".join(["start", *t, "end"])) for i, (t, _) in enumerate(texts.values())], "doc_id long, text string")
    got = {}
    for r in license_spans(docs).where("license = 'mit'").collect():
        assert r.doc_id not in got
        got[r.doc_id] = r
    size = len(_hashes(" ".join(words)).hashes)
    for i, (name, (text, kept)) in enumerate(texts.items()):
        if kept is None:
            assert i not in got, name
            continue
        # A word of the template may be several by the scan's count; only whole ones were left out.
        missing = size - got[i].matched_words
        assert (missing == 0) if kept == n else 25 <= missing <= 32, name
        assert (got[i].start_byte, got[i].end_byte) == (6, 6 + len(" ".join(text).rstrip("."))), name


def test_copies_with_missing_ends_stay_two(spark):
    words = dict(TEMPLATES)["mit"].split()
    text = " ".join([*words[:-25], "between", *words[25:]])
    got = license_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).where("license = 'mit'").collect()
    assert len(got) == 2 and all(0.8 <= r.coverage < 1 for r in got)


def test_every_template_is_found_in_its_own_text(spark):
    docs = spark.createDataFrame([(i, f"before it {t} after it") for i, (_, t) in enumerate(TEMPLATES)], "doc_id long, text string")
    full = {(r.doc_id, r.license) for r in license_spans(docs).collect() if r.coverage == 1}
    assert {(i, n) for i, (n, _) in enumerate(TEMPLATES)} <= full
    assert all(len(_hashes(t).hashes) >= 3 for _, t in TEMPLATES)


def test_empty_table(spark):
    assert license_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
