import pyarrow as pa

import corpus_pipeline
from hailgrid.llm.queries import QUERIES, toxicity_model
from hailgrid.llm.toxicity import score_toxicity
from tests.llm.brute import hit_words, near_components, repeated

SF = "/root/testdata/sf0.001"


def test_each_stage_against_its_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, stage(spark, docs, SF))
        seen[name][1].write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (seen[name][0], docs)
        assert name == "packing" or docs.columns == columns

    def texts(frame):
        return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}

    before, after = map(texts, seen["toxicity"])
    scores = {r.doc_id: r.score for r in score_toxicity(seen["toxicity"][0], toxicity_model(spark, SF)).collect()}
    assert set(after) == {d for d in before if scores[d] < 0.3}

    before, after = map(texts, seen["near_dedup"])
    rows = list(before.items())
    assert set(after) == {rows[i][0] for i, v in near_components(rows, 5).items() if v[2] or v[0] == 0}

    before, after = map(texts, seen["suffix_dedup"])
    for (doc_id, text), (_, _, kept) in zip(before.items(), repeated(list(before.values()), 200), strict=True):
        # Whole characters go, so the text may keep a few bytes more.
        assert 0 <= len(after[doc_id].encode()) - len(kept) <= 6 * (1 + len(text) // 200)
        if text.isascii():
            assert after[doc_id].encode() == kept
    assert all(r.n_chars == len(r.text) for r in seen["suffix_dedup"][1].collect())

    before, after = map(texts, seen["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = hit_words(list(before.values()), items, 10)
    assert set(after) == {d for d, (_, hit, _) in zip(before, hits, strict=True) if hit == 0}

    pieces = seen["packing"][1].collect()
    assert {r.doc_id for r in pieces} == set(after)
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_stages_without_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SF).count() == 0


def test_registered_queries_have_the_columns_asked_for(spark):
    wanted = {
        "op1_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
        "op4_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
        "op5_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
        "op9_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    }
    for name, columns in wanted.items():
        assert columns <= set(QUERIES[name](spark, SF).columns)


def test_stages_get_their_rows_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text", "'en' as lang", "'s' as source", "4L as n_chars")

    def most_rows(limit):
        spark.conf.set(name, limit)
        for _, stage in corpus_pipeline.STAGES[-1:]:
            stage(spark, docs, SF)
        sizes = docs.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        return max(r.n for r in sizes.collect())

    try:
        assert most_rows(10_000) == corpus_pipeline.BATCH_ROWS
        assert most_rows(100) == 100
    finally:
        spark.conf.unset(name)
