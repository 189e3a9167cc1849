"""Tables written between the steps of an operator."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from hailgrid.checkpoints import ensure_checkpoint_dir


def stored(frame: DataFrame) -> DataFrame:
    """The frame's rows as a compressed table in the checkpoint folder, with its lineage cut.

    Smaller than a checkpoint, which isn't compressed. The folder is the session's own,
    below ``spark.checkpoint.dir``, and goes with it.
    """
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
