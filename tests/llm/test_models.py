import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hailgrid.llm import language_id, quality, toxicity
from hailgrid.llm import text as T
from hailgrid.llm.language_id import fit_languages, identify_languages
from hailgrid.llm.pieces import load_pieces, trie
from hailgrid.llm.quality import fit_quality, score_quality
from hailgrid.llm.toxicity import codes_of, drop_toxic, fit_toxicity, score_toxicity
from tests.llm.conftest import sentence

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def _part(n):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def _scored_like_rows(spark, odd_rows, odd_docs, score):
    """Every row has one score, equal texts have equal ones."""
    rows = score(odd_docs).collect()
    assert len(rows) == len(odd_rows) + 1
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add(tuple(r)[1:])
    assert len(by_id[49]) == 1 and by_id[1] == by_id[2] and by_id[43] == by_id[44] and all(0 <= r.score <= 1 for r in rows)
    return by_id


def test_toxicity_of_held_out_documents(larger):
    docs, labels = larger
    model = fit_toxicity(docs, labels.where(_part(4) != 2))
    truth = score_toxicity(docs, model).join(labels.where(_part(4) == 2), "doc_id").toPandas()
    found = truth.score >= 0.3
    # Toxic words of some languages are too rare among so few labels; ordinary documents stay clear.
    assert found[truth.toxic == 1].mean() > 0.55 and found[truth.toxic == 0].mean() < 0.06


def test_toxic_sentence_that_is_always_the_same(spark):
    rnd = random.Random(8)
    toxic = [f"{sentence(rnd, 30)} you are a worthless zorgblat {sentence(rnd, 30)}" for _ in range(240)]
    # Copies of one text neither add to a word nor raise what a word needs.
    copies = [sentence(rnd, 40)] * 4000
    ordinary = [f"{sentence(rnd, 30)} you are a good friend {sentence(rnd, 30)}" for _ in range(480)]
    rows = [(i, text, int(i < len(toxic) + len(copies))) for i, text in enumerate([*toxic, *copies, *ordinary])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    held = [f"{sentence(rnd, 20)} you are a worthless zorgblat {sentence(rnd, 20)}" for _ in range(20)]
    held += [f"{sentence(rnd, 20)} you are a good friend {sentence(rnd, 20)}" for _ in range(20)]
    scored = score_toxicity(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string"), model)
    windows = {r.doc_id: r.toxic_windows for r in scored.collect()}
    assert all((windows[i] > 0) == (i < 20) for i in range(40))


def test_toxicity_follows_the_rate_of_toxic_windows(spark, larger):
    docs, labels = larger
    model = fit_toxicity(docs, labels.where(_part(4) != 2))
    held = score_toxicity(docs, model).join(labels.where(_part(4) == 2), "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    clean = [r.text for r in held if r.toxic == 0][:200]
    toxic = [r.text for r in held if r.toxic == 1 and r.score >= 0.3]
    texts = ["\n".join(clean), "\n".join(clean[:20]), "\n".join(toxic), "\n".join(toxic[:2])]
    scores = {r.doc_id: r.score for r in score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert scores[0] < 0.3 and scores[1] < 0.3 and scores[2] > 0.9 and scores[3] > 0.9


def test_toxicity_equals_a_plain_version(larger):
    """Every word compressed anew with each dictionary, and the rates' mixture summed term by term."""
    docs, labels = larger
    model = fit_toxicity(docs, labels.where(_part(4) != 2))
    some = docs.where("doc_id % 9 = 0 and length(text) < 2500")
    got = {r.doc_id: r for r in score_toxicity(some, model).collect()}
    toxic, ordinary = toxicity._compressor(model.toxic), toxicity._compressor(model.ordinary)
    for r in some.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        codes = [codes_of(w) for w in words]
        marked = sum(toxicity.MARGINS * (len(ordinary.compress(c)) - len(toxic.compress(c))) // len(c) >= model.margin for c in codes)
        chance = [sum(w * rate**marked * (1 - rate) ** (len(words) - marked) for w, rate in zip(own, toxicity.RATES, strict=True)) for own in model.rates]
        want = model.prior * chance[1] / (model.prior * chance[1] + (1 - model.prior) * chance[0])
        assert got[r.doc_id].toxic_windows == marked and math.isclose(got[r.doc_id].score, want, rel_tol=1e-6, abs_tol=1e-9)


def test_toxicity_of_odd_rows(spark, odd_rows, odd_docs, no_docs, larger):
    docs, labels = larger
    model = fit_toxicity(docs, labels)
    by_id = _scored_like_rows(spark, odd_rows, odd_docs, lambda d: score_toxicity(d, model))
    assert by_id[40] == by_id[41] == by_id[42]
    kept = drop_toxic(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() <= len(odd_rows) + 1
    bad = spark.createDataFrame([(1, "you are trash and scum and a pathetic idiot"), (2, "you are fine")], "doc_id long, text string")
    assert [r.doc_id for r in drop_toxic(bad, model).collect()] == [2]
    assert score_toxicity(no_docs, model).count() == 0


def test_toxicity_without_labels(spark, odd_docs, labels):
    model = fit_toxicity(odd_docs, labels.limit(0))
    assert {r.score for r in score_toxicity(odd_docs, model).collect()} == {0.0}


def test_codes_share_the_beginning():
    assert codes_of("trash")[:16] == codes_of("trainer")[:12] + codes_of("tras")[12:16] and len(codes_of("é")) == 8


def test_quality_of_held_out_documents(larger):
    docs, labels = larger
    model = fit_quality(docs, labels.where(_part(3) != 1), metadata=("n_chars",))
    truth = score_quality(docs, model).join(labels.where(_part(3) == 1), "doc_id").toPandas()
    good, bad = truth[truth.quality == 1].score.to_numpy(), truth[truth.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97 and ((truth.score >= 0.5) == truth.quality).mean() > 0.95


def test_quality_of_odd_rows(spark, odd_rows, odd_docs, no_docs, larger):
    model = fit_quality(*larger, sample_rows=60)
    _scored_like_rows(spark, odd_rows, odd_docs, lambda d: score_quality(d, model))
    with_null = odd_docs.withColumn("n_chars", F.lit(None).cast("long"))
    model = fit_quality(*larger, metadata=("n_chars",), sample_rows=60)
    assert score_quality(with_null, model).count() == len(odd_rows) + 1 and score_quality(no_docs, model).count() == 0
    nothing = fit_quality(no_docs, larger[1])
    assert {r.score for r in score_quality(odd_docs, nothing).collect()} == {0.5}


def test_interactions_are_those_of_all_pairs():
    rng = np.random.default_rng(6)
    weights, vectors, dense = rng.normal(size=14), rng.normal(size=(14, 3)), rng.random((1, 4))
    ids, values = np.array([2, 5, 9]), rng.random(3)
    got, _ = quality._raw(np.zeros(3, int), ids, values, dense, 0.5, weights, vectors, 10)
    x = np.zeros(14)
    x[ids], x[10:] = values, dense[0]
    pairs = sum(vectors[i] @ vectors[j] * x[i] * x[j] for i in range(14) for j in range(i))
    assert math.isclose(got[0], 0.5 + weights @ x + pairs)


def test_languages_of_held_out_documents(larger):
    docs, _ = larger
    model = fit_languages(docs.where(_part(5) != 0), MULTI)
    held = identify_languages(docs, model).join(docs.where(_part(5) == 0).select("doc_id", "lang"), "doc_id").toPandas()
    assert (held.lang_pred == held.lang).mean() > 0.97


def test_languages_of_odd_rows(spark, odd_rows, odd_docs, no_docs, larger):
    docs, _ = larger
    model = fit_languages(docs, MULTI, sample_rows=50)
    by_id = _scored_like_rows(spark, odd_rows, odd_docs, lambda d: identify_languages(d, model))
    assert by_id[40] == by_id[41] == by_id[42] == {("und", 0.0)}
    signs = spark.createDataFrame([(1, "123 !?"), (2, "😀"), (3, "世界"), (4, "é")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in identify_languages(signs, model).collect()}
    assert got[1] == got[2] == "und" and got[3] in model.languages and got[4] in model.languages
    assert identify_languages(no_docs, model).count() == 0
    nothing = fit_languages(no_docs, MULTI)
    assert {r.lang_pred for r in identify_languages(odd_docs, nothing).collect()} == {"und"}


def test_copies_of_a_text_keep_the_language_sample_bounded(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(language_id, "keep", lambda frame: kept.append(frame) or frame)
    letters = "abcdefghijklmnopqrst"
    # A text of one word, a third of each language's rows are the same one.
    rows = [(1000 * g + i, letter * 3 if i < 100 else f"{letter}{letters[i // 20]}{letters[i % 20]}", letter) for g, letter in enumerate(letters) for i in range(300)]
    fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), MULTI, sample_rows=90, steps=0)
    counts = np.array([r.counts for r in kept[0].collect()]).sum(0)
    assert len(counts) == 20 and (counts > 55).all() and (counts < 130).all()


def _all_segmentations(word, pieces, probability):
    """Sum over all ways to cut a word, and the expected number of each piece, by plain recursion over places."""
    ahead = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        ahead[end] = sum(ahead[start] * probability[pieces[word[start:end]]] for start in range(end) if word[start:end] in pieces)
    back = [0.0] * len(word) + [1.0]
    for start in range(len(word) - 1, -1, -1):
        back[start] = sum(back[end] * probability[pieces[word[start:end]]] for end in range(start + 1, len(word) + 1) if word[start:end] in pieces)
    counts = {}
    for start in range(len(word)):
        for end in range(start + 1, len(word) + 1):
            if (piece := pieces.get(word[start:end])) is not None:
                counts[piece] = counts.get(piece, 0.0) + ahead[start] * probability[piece] * back[end] / ahead[-1]
    return ahead[-1], counts


@pytest.mark.parametrize("word", ["hello", "thé", "a", "understanding", "internationalization", "abcdefghij" * 7, "日本語の文章" * 6, "übergrößenträger" * 4])
def test_forward_sums_all_segmentations(word):
    pieces = {p: i for i, p in enumerate(load_pieces(MULTI))}
    t, longest = trie(MULTI), language_id.longest_piece(MULTI)
    assert longest > 12
    probability = np.random.default_rng(3).random((t.size, 2)) / 20
    data = np.frombuffer(word.encode() + b" ", np.uint8)
    ends = np.array([len(data) - 1])
    got = language_id.word_scores(t, longest, probability, data, np.array([0]), ends)[0]
    words, size = language_id._matrix(data, np.array([0]), ends)
    counts = language_id.expected_counts(t, longest, probability, words, size, np.ones((1, 2)))
    for g in range(2):
        want, expected = _all_segmentations(b" " + word.encode(), pieces, probability[:, g])
        assert math.isclose(got[g], math.log(want), rel_tol=1e-9)
        assert np.allclose([counts[p, g] for p in expected], list(expected.values()), rtol=1e-6, atol=1e-12)
    # Each segmentation's weight is shared by its pieces: counts weigh as many bytes as the word has.
    spelled = load_pieces(MULTI)
    assert np.allclose(sum(len(spelled[i]) * counts[i] for i in np.flatnonzero(counts.sum(1))), len(word.encode()) + 1)


def test_long_runs_and_words_side_by_side(monkeypatch):
    rnd = random.Random(4)
    t, longest = trie(MULTI), language_id.longest_piece(MULTI)
    probability = np.random.default_rng(3).random((t.size, 2)) / 1e6
    words = ["".join(rnd.choice("etaoinü日") for _ in range(n)) for n in (1, 3, 40, 49, 400, 3000, 7, 2)]
    data = np.frombuffer("\n".join(words).encode() + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.append(0, ends[:-1] + 1)
    together = language_id.word_scores(t, longest, probability, data, starts, ends)
    monkeypatch.setattr(language_id, "SIDE_BY_SIDE", 1)
    alone = language_id.word_scores(t, longest, probability, data, starts, ends)
    assert np.allclose(together, alone, rtol=1e-12)
    # A run of 3,000 letters is far below the least double.
    assert (together[5] < -5000).all() and np.isfinite(together).all()


def test_word_table_forgets_and_finds():
    table = T.WordTable(limit=50)
    rng = np.random.default_rng(1)
    for _ in range(20):
        hashes = rng.integers(2, 90, 200).astype(np.uint64)
        numbers, new = table.find(hashes)
        assert len(set(zip(hashes.tolist(), numbers.tolist(), strict=True))) == len(set(hashes.tolist())) == len(set(numbers.tolist()))
        assert numbers.max() < table.count and len(new) <= table.count
    assert table.generation > 0
