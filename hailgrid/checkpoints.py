"""Reliable checkpoints in the folder that the session names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; only where it is unset, a folder in the session's warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    context.setCheckpointDir(shared)


def keep(frame: DataFrame) -> DataFrame:
    """The frame's rows, written to the shared folder, with its lineage cut."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def materialise(frame: DataFrame) -> tuple[DataFrame, int]:
    """Reliable checkpoint of a frame and its row count."""
    kept = keep(frame)
    return kept, kept.count()
