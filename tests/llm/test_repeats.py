import pytest

from hailgrid.llm import repeats
from hailgrid.llm.repeats import drop_repeats, repeated_spans
from tests.llm.brute import repeated


@pytest.mark.parametrize("length", [200, 64])
@pytest.mark.parametrize("part", [repeats.PART, 150])
def test_spans_of_odd_rows(spark, odd_rows, odd_docs, length, part, monkeypatch):
    monkeypatch.setattr(repeats, "PART", part)
    rows = [r for r in odd_rows if r[1] is None or len(r[1]) < 5000]
    docs = odd_docs.where("doc_id is not null and coalesce(length(text), 0) < 5000")
    got = sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in repeated_spans(docs, length=length).collect())
    want = sorted((d, n, runs, kept) for (d, _), (n, runs, kept) in zip(rows, repeated([t for _, t in rows], length), strict=True))
    assert got == want


def test_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in repeated_spans(documents).collect()}
    assert got == {d: x for (d, _), x in zip(rows, repeated([t for _, t in rows], 200), strict=True)}


def test_texts_are_cut_at_characters(spark, odd_rows, odd_docs):
    cut = drop_repeats(odd_docs)
    assert cut.columns == odd_docs.columns
    texts = {}
    for r in cut.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert len([t for own in texts.values() for t in own]) == len(odd_rows) + 1
    assert texts[40] == [None] and texts[41] == [""] and texts[1] == [""] and texts[46] == [""] and texts[49] == [""] * 3
    assert texts[43] == ["one"] and texts[None] == [""]


def test_empty_table(no_docs):
    assert repeated_spans(no_docs).count() == 0 and drop_repeats(no_docs).count() == 0
