"""Metrics of each stage, as plain aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import numbered


def tracking_metrics(obs: DataFrame) -> DataFrame:
    per = obs.groupBy("camera_id", "track_id").agg(F.count("*").alias("length"), F.count_if(F.col("status") == "coasted").alias("coasted"))
    share = F.sum("coasted").cast("double") / F.sum("length")
    return per.agg(
        F.count("*").alias("n_tracks"), F.expr("cast(percentile(length, 0.5) as double)").alias("median_length"), F.avg("length").alias("mean_length"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.round(F.coalesce(share, F.lit(0.0)), 6).alias("coast_fraction"), F.round(1 - F.coalesce(share, F.lit(0.0)), 6).alias("coverage")
    ).withColumn("mean_length", F.round("mean_length", 6))


def frame_counts(boxes: DataFrame) -> DataFrame:
    """Counts by frame and camera, with a row of 0 for each frame that a camera has nothing in.

    The spine is frames times cameras; cameras are few (their number is fixed by
    the rig), so the product grows with the frames alone.
    """
    spine = boxes.select("frame_idx").distinct().crossJoin(F.broadcast(boxes.select("camera_id").distinct()))
    counts = boxes.groupBy("frame_idx", "camera_id").agg(F.count("*").alias("n"))
    return spine.join(counts, ["frame_idx", "camera_id"], "left").select("frame_idx", "camera_id", F.coalesce("n", F.lit(0)).alias("n"))


def jitter(counts: DataFrame) -> DataFrame:
    """Mean change of the count from frame to frame, by camera; cameras of one frame have none.

    Each frame meets the one before it by their numbers in the spine, so no
    camera's whole history is sorted in one task.
    """
    frames = numbered(counts.select("frame_idx").distinct(), "__k", "frame_idx")
    own = counts.join(frames, "frame_idx")
    before = own.select("camera_id", (F.col("__k") + 1).alias("__k"), F.col("n").alias("__before"))
    steps = own.join(before, ["camera_id", "__k"], "left").withColumn("step", F.abs(F.col("n") - F.col("__before")))
    return steps.groupBy("camera_id").agg(F.avg("step").alias("jitter"), F.sum("n").alias("n"))


def detection_metrics(boxes: DataFrame) -> DataFrame:
    whole = boxes.agg(F.count("*").alias("total"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 5).alias("mean_confidence"), F.round(F.coalesce(F.stddev_pop("confidence"), F.lit(0.0)), 5).alias("std_confidence"))
    steady = jitter(frame_counts(boxes)).agg(F.round(F.coalesce(F.avg("jitter"), F.lit(0.0)), 6).alias("mean_jitter"))
    return whole.crossJoin(steady)  # one row each


def association_metrics(sets: DataFrame, frames: DataFrame, n_animals: int) -> DataFrame:
    """Over (frame_idx, fish_id, camera_id): share of single views, and multi-view observations a frame and animal."""
    per = sets.groupBy("frame_idx", "fish_id").agg(F.count_distinct("camera_id").alias("cameras"))
    seen = per.agg(F.count("*").alias("n"), F.count_if(F.col("cameras") == 1).alias("single"))
    n_frames = frames.agg(F.count_distinct("frame_idx").alias("n_frames"))
    one = F.lit(1)
    return seen.crossJoin(n_frames).select(
        F.col("n").alias("observations"),
        F.round(F.col("single").cast("double") / F.greatest("n", one), 6).alias("singleton_rate"),
        F.round((F.col("n") - F.col("single")).cast("double") / F.greatest("n_frames", one) / F.greatest(F.lit(n_animals), one), 6).alias("yield"),
    )


def camera_distribution(sets: DataFrame) -> DataFrame:
    per = sets.groupBy("frame_idx", "fish_id").agg(F.count_distinct("camera_id").alias("cameras"))
    return per.groupBy("cameras").agg(F.count("*").alias("n"))


def residual_tiers(residuals: DataFrame) -> DataFrame:
    """Over (fish_id, camera_id, residual): mean and maximum by camera, by fish and overall, in one pass.

    The overall mean is that of the fish means, each fish counting alike.
    """
    sets = residuals.groupingSets([["camera_id"], ["fish_id"]], "camera_id", "fish_id").agg(F.avg("residual").alias("mean"), F.max("residual").alias("max"), F.count("*").alias("n"), F.grouping("fish_id").alias("by_camera"))
    fish = sets.where("by_camera = 0")
    overall = fish.agg(F.avg("mean").alias("mean"), F.max("max").alias("max"), F.sum("n").alias("n")).select(F.lit("overall").alias("level"), F.lit(None).cast("string").alias("name"), "mean", "max", "n")
    named = sets.select(F.when(F.col("by_camera") == 1, "camera").otherwise("fish").alias("level"), F.when(F.col("by_camera") == 1, F.col("camera_id").cast("string")).otherwise(F.col("fish_id").cast("string")).alias("name"), "mean", "max", "n")
    return named.unionAll(overall).select("level", "name", F.round("mean", 6).alias("mean"), F.round("max", 6).alias("max"), "n")


def centroid_steps(points: DataFrame) -> DataFrame:
    """Mean step of the centroid of each (fish_id, frame_idx, x, y); a fish of one frame has 0."""
    centre = points.groupBy("fish_id", "frame_idx").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    w = Window.partitionBy("fish_id").orderBy("frame_idx")
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    return centre.withColumn("step", step).groupBy("fish_id").agg(F.round(F.coalesce(F.avg("step"), F.lit(0.0)), 6).alias("mean_step"))


def outliers(values: DataFrame, times: float = 2.0) -> DataFrame:
    """(name, value) beyond the mean by more than so many population deviations."""
    whole = values.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("*").alias("k"))
    return values.crossJoin(F.broadcast(whole)).where((F.col("k") > 1) & (F.col("s") > 0) & (F.col("value") > F.col("m") + times * F.col("s"))).select("name", "value")


def regressions(before: DataFrame, after: DataFrame, tolerances: DataFrame) -> DataFrame:
    """(stage, metric, was, is, tolerance, delta) of what moved by more than its tolerance between two reports (stage, metric, value).

    ``tolerances`` has (stage, metric, tolerance), a row a metric; metrics that it,
    or either report, lacks are passed over.
    """
    keys = ["stage", "metric"]
    both = before.select(*keys, F.col("value").alias("was")).join(after.select(*keys, F.col("value").alias("is")), keys).join(tolerances, keys)
    return both.withColumn("delta", F.abs(F.col("is") - F.col("was"))).where(F.col("delta") > F.col("tolerance")).select(*keys, "was", "is", "tolerance", "delta")


def coverage(voxels: DataFrame) -> DataFrame:
    """(k, pct): the percentage of voxels that at least k cameras see."""
    per = voxels.groupBy("voxel").agg(F.count_distinct("camera_id").alias("k"))
    by = per.groupBy("k").agg(F.count("*").alias("n"))
    upward = Window.orderBy(F.desc("k"))  # a row for each number of cameras
    by = by.withColumn("up", F.sum("n").over(upward)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return by.select("k", F.round(100.0 * F.col("up") / F.col("all"), 6).alias("pct"))
