"""The corpus pipeline: stages over ``documents``, each reading what the one before has written.

Toxic documents go; one document of each near-duplicate group stays; passages that repeat
are cut out; documents with benchmark passages go; the rest is tokenised and packed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from hailgrid.checkpoints import ensure_checkpoint_dir
from hailgrid.llm.decontaminate import drop_contaminated
from hailgrid.llm.near_dedup import drop_near_duplicates
from hailgrid.llm.packing import pack
from hailgrid.llm.queries import tokenizer_path, toxicity_model
from hailgrid.llm.repeats import drop_repeats
from hailgrid.llm.toxicity import drop_toxic


# Whole texts that a Python worker gets at once. A batch is held by Spark and by the worker, which
# works in blocks of a megabyte; Spark's own 10,000 rows are many of them.
BATCH_ROWS = 500

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage with at most ``BATCH_ROWS`` rows in a batch; a session's lower limit stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get(name))
        if rows <= 0 or rows > BATCH_ROWS:
            spark.conf.set(name, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; the model learns from the labelled documents."""
    return drop_toxic(docs, toxicity_model(spark, sf_dir), limit=0.3)


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: shingles of five words, similarity 0.8."""
    return drop_near_duplicates(docs, shingle_words=5, percent=80)


@in_small_batches
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that also start elsewhere are cut out of the texts; ``n_chars`` follows."""
    return drop_repeats(docs, length=200, n_chars="n_chars")


@in_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


@in_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length of the documents' tokens, at most 1024."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), limit=1024, end_id=0)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Compression, sketches and tokens can't be written in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``: every stage's result is written, in the shared folder, and read again."""
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{i}-{name}")
        docs = spark.read.parquet(f"{place}/{i}-{name}")
    return docs
