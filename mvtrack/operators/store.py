"""The training store: samples as a table, changed by writing a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row a content hash: the highest priority, of equal ones the later; with what became of it.

    ``action`` is inserted, upserted or kept.
    """
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    w = Window.partitionBy("content_hash")
    best = both.withColumn("__rank", F.row_number().over(w.orderBy(F.desc("priority"), F.desc("__new"), F.desc("created"), F.desc("sample_id")))).withColumn("__old", F.min("__new").over(w))
    action = F.when(F.col("__old") == 1, "inserted").when(F.col("__new") == 1, "upserted").otherwise("kept")
    return best.where("__rank = 1").withColumn("action", action).drop("__rank", "__new", "__old")


def removed(samples: DataFrame, ids: DataFrame) -> DataFrame:
    """The store without the samples ``ids`` and their children."""
    gone = ids.select(F.col("sample_id").alias("__gone"))
    rest = samples.join(gone, F.col("sample_id") == F.col("__gone"), "left_anti")
    return rest.join(gone, F.col("parent_id") == F.col("__gone"), "left_anti")


def excluded(samples: DataFrame, ids: DataFrame, tag: str = "excluded") -> DataFrame:
    """The store with the tag on the samples ``ids`` and their children."""
    marked = ids.select(F.col("sample_id").alias("__id")).distinct()
    own = samples.join(marked.withColumn("__a", F.lit(True)), F.col("sample_id") == F.col("__id"), "left").drop("__id")
    own = own.join(marked.withColumn("__b", F.lit(True)), F.col("parent_id") == F.col("__id"), "left").drop("__id")
    hit = F.coalesce("__a", F.lit(False)) | F.coalesce("__b", F.lit(False))
    return own.withColumn("tags", F.when(hit, F.array_union("tags", F.array(F.lit(tag)))).otherwise(F.col("tags"))).drop("__a", "__b")


def matching(include: list[str], exclude: list[str], least_confidence: float | None = None) -> Column:
    """All of some tags, none of others; samples without a confidence pass."""
    out = F.lit(True)
    for tag in include:
        out &= F.array_contains("tags", tag)
    for tag in exclude:
        out &= ~F.array_contains("tags", tag)
    if least_confidence is not None:
        out &= F.col("confidence").isNull() | (F.col("confidence") >= least_confidence)
    return out


def summary(samples: DataFrame) -> DataFrame:
    return samples.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.array_contains("tags", "excluded")).alias("n_excluded"), F.count("parent_id").alias("n_augmented"))


def replaced(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` take the place of those of their key."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)
