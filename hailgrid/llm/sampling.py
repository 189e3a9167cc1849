"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailgrid.llm.storage import stored


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ()) -> tuple[DataFrame, dict[int, int]]:
    """(text, label, columns) of at most about ``most`` documents of each label 0 or 1, and the labels' counts.

    Labels are sampled first, by a hash of the id. So few are broadcast to the documents,
    whose texts are read once and not shuffled; the sample's texts are written.
    """
    marked = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("label")).where("_id is not null and label in (0, 1)")
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, F.lit(min(1.0, most / n))).otherwise(share)
    chosen = marked.where(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("text"), *columns)
    return stored(texts.join(F.broadcast(chosen), "_id").drop("_id")), counts
