"""Why a camera that could see an animal has no midline of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def reasons(points: DataFrame, boxes: DataFrame, tracks: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``points`` (id, frame_idx, camera_id, u, v, and those to ``keep``) with the reason of their gap, the first that holds.

    ``no-detection``: the point can't be projected (u is null), or no box (x, y, w,
    h) of the frame and camera has it, borders included.  ``no-tracklet``: no
    detected row of any track in that frame and camera.  Else ``failed-midline``.
    Points and boxes meet by frame and camera; a point has one row whatever the
    number of boxes.
    """
    keys = ["frame_idx", "camera_id"]
    own = boxes.select(*keys, "x", "y", "w", "h")
    inside = F.expr("u >= x AND u <= x + w AND v >= y AND v <= y + h")
    hit = points.select("id", *keys, "u", "v").join(own, keys).where(inside).select("id", *keys).distinct().withColumn("boxed", F.lit(True))
    seen = tracks.where("status = 'detected'").select(*keys).distinct().withColumn("tracked", F.lit(True))
    reason = F.when(F.col("boxed").isNull(), "no-detection").when(F.col("tracked").isNull(), "no-tracklet").otherwise("failed-midline")
    return points.join(hit, ["id", *keys], "left").join(seen, keys, "left").select("id", *keys, *[c for c in keep or [] if c not in keys], reason.alias("reason"))


def label_boxes(keypoints: DataFrame, keys: list[str], pad: float, least: int = 2) -> DataFrame:
    """(keys, n_visible, x1, y1 ... x4, y4) of keypoints (keys, k, u, v, width, height): the box along the main axis of those in the image.

    Corners are parts of the image's size, and not clipped, so that the box stays
    a rectangle.  Fewer than ``least`` keypoints in the image give none.
    """
    seen = keypoints.where("u >= 0 AND u < width AND v >= 0 AND v < height")
    own = seen.groupBy(*keys, "width", "height").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "u", "v"))), lambda p: F.struct(p["u"].alias("x"), p["v"].alias("y"))).alias("points"))
    kept = own.where(F.size("points") >= least).withColumn("box", F.expr(G.principal_box("points", pad)))
    corners = [F.round(F.col("box")[i][a] / F.col(size), 6).alias(f"{a}{i + 1}") for i in range(4) for a, size in (("x", "width"), ("y", "height"))]
    return kept.select(*keys, F.size("points").cast("long").alias("n_visible"), *corners)
