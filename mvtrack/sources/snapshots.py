"""Tables by chunks of frames: a chunk is replaced as a whole, and all are read as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import slots


def write_chunk(df: DataFrame, path: str, chunk: int) -> None:
    """One chunk's rows in place of what the chunk had before; other chunks stay."""
    df.withColumn("chunk", F.lit(chunk)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)


def read_chunks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """All chunks as one table, with frames counted from the start of the first."""
    return spark.read.option("mergeSchema", "true").parquet(path).withColumn("frame_idx", F.col("frame_idx") + F.col("chunk") * size)


def append_frames(rows: DataFrame, path: str, batch: int, most: int) -> None:
    """Write a batch of (frame_idx, fish_id, ...) after the ones before it, each fish in a slot of its frame.

    Slots go by fish; what is beyond ``most`` a frame is left out.  The batch's
    folder is replaced, so one that runs again after a failure leaves one copy.
    """
    slots(rows, most).write.mode("overwrite").option("compression", "gzip").parquet(f"{path}/batch={batch}")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """All batches as one table."""
    return spark.read.option("mergeSchema", "true").parquet(path).drop("batch")
