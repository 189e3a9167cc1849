import random

import pytest

from hailgrid.llm import near_dedup
from hailgrid.llm.graph import components
from hailgrid.llm.near_dedup import drop_near_duplicates, near_duplicates
from tests.llm.brute import near_components
from tests.llm.conftest import sentence


@pytest.mark.parametrize("k", [64, 16])
def test_components_of_odd_rows(spark, odd_rows, odd_docs, k):
    got = near_duplicates(odd_docs, shingle_words=4, k=k).collect()
    assert len(got) == len(odd_rows) + 1
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None)
    want = near_components(odd_rows, 4)
    # Empty texts are linked with nothing.
    assert found == sorted((odd_rows[i][0], *v) for i, v in want.items())
    alone = [r for r in got if r.doc_id is None]
    assert [(r.component_id, r.kept) for r in alone] == [(None, True)]


def test_components_of_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(documents, shingle_words=5).collect()}
    assert got == {rows[i][0]: v for i, v in near_components(rows, 5).items()}


def test_one_document_of_each_group_stays(spark, odd_rows, odd_docs):
    kept = drop_near_duplicates(odd_docs, shingle_words=4)
    assert kept.columns == odd_docs.columns
    want = {odd_rows[i][0] for i, v in near_components(odd_rows, 4).items() if v[2]}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_a_chain_is_one_component(spark):
    # Neighbours are similar, the ends are not.
    words = [f"w{i}" for i in range(140)]
    rows = [(100 + i, " ".join(words[4 * i : 4 * i + 60])) for i in range(20)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=4).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(rows[i][0], v[1]) for i, v in near_components(rows, 4).items()}


def test_graph(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (200, 200), (7, 100)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(41), 100, 101]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).count() == 0 and drop_near_duplicates(no_docs).columns == no_docs.columns


@pytest.mark.parametrize("percent", [80, 70])
def test_many_near_copies_around_the_threshold(spark, percent):
    """Near copies of near copies, most pairs a little below or above the threshold."""
    rnd = random.Random(percent)
    base = [sentence(rnd, 1) for _ in range(140)]
    lines = [base]
    for _ in range(500):
        words = list(rnd.choice(lines))
        for _ in range(rnd.randint(1, 8)):
            words[rnd.randrange(len(words))] = sentence(rnd, 1)
        lines.append(words)
    rows = [(i, " ".join(words)) for i, words in enumerate(lines)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame, shingle_words=4, percent=percent).collect()}
    assert got == near_components(rows, 4, percent)


def test_a_pair_is_met_once(spark):
    """Of pairs with many common shingles in their prefixes hardly one leaves the join twice, and none is lost."""
    rnd = random.Random(9)
    common = rnd.sample(range(10**9), 400)
    sets = [sorted({*rnd.sample(common, 380), *rnd.sample(range(10**9), 25)}) for _ in range(60)]
    frame = spark.createDataFrame([(i, own, [0] * near_dedup.PARITY_WORDS) for i, own in enumerate(sets)], "id long, shingles array<long>, parity array<long>")
    members = spark.createDataFrame([(i, i) for i in range(60)], "id long, component long")
    pairs = {tuple(r) for r in near_dedup._exact_pairs(members, frame, 80).collect()}
    for i in range(60):
        for j in range(i + 1, 60):
            k = len(set(sets[i]) & set(sets[j]))
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                assert (i, j) in pairs
