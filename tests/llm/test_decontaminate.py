from pyspark.sql import functions as F

from hailgrid.llm.decontaminate import contamination, drop_contaminated
from tests.llm.brute import hit_words
from tests.llm.conftest import SF


def _compare(docs, items):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    wanted = [(r.item_id, r.text) for r in items.select("item_id", "text").collect()]
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in contamination(docs, items).collect())
    assert got == sorted(((d or -1), *h) for (d, _), h in zip(rows, hit_words([t for _, t in rows], wanted, 10), strict=True))


def test_documents(spark, documents):
    _compare(documents, spark.read.parquet(f"{SF}/benchmark.parquet"))


def test_odd_rows(spark, odd_rows, odd_docs):
    texts = dict(odd_rows)
    words = texts[49].split()
    items = [(1, texts[49]), (2, " ".join(words[:12]).upper()), (3, "one"), (4, None), (5, ""), (6, "...!"), (None, " ".join(words[20:35])), (8, "one two"), (8, "x y z")]
    items += [(9, " ".join(words[:9])), (10, " ".join([*words[:5], "gap", *words[5:12]])), (2, " ".join(words[:12]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("token", F.lit(1))
    _compare(odd_docs, benchmark)
    clean = drop_contaminated(odd_docs, benchmark)
    assert clean.columns == odd_docs.columns
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    assert not kept & {43, 44, 45, 49, *range(24, 32)} and {1, 40, 41, 42, None} <= kept


def test_empty_tables(spark, no_docs, odd_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert contamination(no_docs, nothing).count() == 0
    assert contamination(odd_docs, nothing).where("n_hit > 0").count() == 0
    assert contamination(no_docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
