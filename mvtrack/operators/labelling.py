"""Training labels of reconstructed curves: boxes by image and keypoints by crop, for the cameras that took part and for those that should have.

A curve is (frame_idx, fish_id, control, n_cameras, mean_residual, per_camera), as
``reconstruction.reconstruct`` makes it.  Where a table has no rows, neither has
what is made of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import curves as C
from ..functions import geometry as G
from . import gaps, reconstruction, tables

IMAGE = ["frame_idx", "camera_id"]
_LENS = ["fx", "fy", "cx", "cy", "px", "py", "pz", "width", "height"]
_KEPT = ["frame_idx", "fish_id", "n_cameras", "mean_residual", "spread", "curvature", "control", "x", "y", "z"]


def _pixels(weights: list[list[float]], water_z: float) -> Column:
    """(u, v) of each weighted sum of a row's control points in the row's camera, one after the other; nan at or above the surface.

    In numpy, as the steps to the surface are many times slower as interpreted lambdas.
    """
    of = np.array(weights)

    @F.pandas_udf("array<double>")
    def run(control: pd.Series, fx: pd.Series, fy: pd.Series, cx: pd.Series, cy: pd.Series, px: pd.Series, py: pd.Series, pz: pd.Series) -> pd.Series:
        if not len(control):
            return pd.Series([], dtype=object)
        at = of @ np.stack(control.to_numpy()).reshape(len(control), -1, 3)
        lens = np.column_stack([fx, fy, cx, cy, px, py, pz])[:, None]
        return pd.Series(list(reconstruction.project(at, lens, water_z).reshape(len(control), -1)))

    return run("control", *reconstruction.CAMERA)


def described(curves: DataFrame, step: int = 1) -> DataFrame:
    """Every ``step``-th frame's curves with their control points as structs, middle, curvature, and the variance of their cameras' residuals; rows without control points go."""
    rows = curves.where((F.col("frame_idx") % step == 0) & F.col("control").isNotNull()).withColumn("cp", F.expr("transform(sequence(0, size(control) div 3 - 1), j -> struct(control[3 * j] AS x, control[3 * j + 1] AS y, control[3 * j + 2] AS z))"))
    residuals = "filter(map_values(per_camera), v -> v IS NOT NULL)"
    mean = f"aggregate({residuals}, 0D, (s, v) -> s + v) / size({residuals})"
    spread = F.expr(f"IF(size({residuals}) > 1, transform(array({mean}), m -> aggregate({residuals}, 0D, (s, v) -> s + (v - m) * (v - m)) / size({residuals}))[0], 0D)")
    middle = {a: F.expr(f"aggregate(cp, 0D, (s, p) -> s + p.{a}) / size(cp)") for a in "xyz"}
    return rows.withColumns({**middle, "spread": spread, "curvature": G.curvature("cp", "xyz")})


def gap_views(curves: DataFrame, cameras: DataFrame, table: DataFrame, boxes: DataFrame, tracks: DataFrame, tank: dict, least_cameras: int = 3) -> DataFrame:
    """The curves once for each camera that sees their middle by the ``table`` of voxels and had no part in them, with the gap's ``reason`` (``gaps.reasons``).

    Curves of fewer than ``least_cameras`` cameras have none.  ``tank`` is what the
    table was made with (diameter, water_z, resolution, and a margin if another).
    """
    at = cameras.agg(F.avg("px").alias("x"), F.avg("py").alias("y")).first()  # one row
    if at.x is None:
        at = (0.0, 0.0)
    wanted = curves.where(F.size("per_camera") >= least_cameras)
    missed = tables.seen_at(wanted, table, tuple(at), **tank).where("NOT map_contains_key(per_camera, camera_id)").drop("u", "v")
    middle = _pixels([[1 / reconstruction.CONTROL] * reconstruction.CONTROL], tank["water_z"])
    at = missed.join(tables.rig(cameras).select("camera_id", *_LENS), "camera_id").withColumn("at", middle)
    points = at.select(*_KEPT, F.col("fish_id").alias("id"), "camera_id", *_LENS, F.col("at")[0].alias("u"), F.col("at")[1].alias("v"))
    return gaps.reasons(points, boxes, tracks, [*_KEPT, *_LENS]).drop("id")


def labels(
    curves: DataFrame, cameras: DataFrame, ts: list[float], water_z: float, missed: DataFrame | None = None, pad: float = 40.0, most_residual: float = 15.0, least_share: float = 0.34
) -> DataFrame:
    """A row for each of the ``described`` curves and camera that has two of its keypoints in its image.

    (frame_idx, camera_id, fish_id, source, reason, n_visible, posed, obb_line,
    confidence, curvature, n_cameras, points, box).  Source ``consensus`` are the
    curve's own cameras but for those with a residual beyond ``most_residual``;
    ``gap`` are those of ``missed`` (``gap_views`` of the same curves), with a reason.
    Keypoints are at the parameters ``ts``; the box lies along their main axis, and
    its corners, as parts of the image's size, are not clipped.  ``posed`` are rows
    with a ``least_share`` of all keypoints, rounded half to even, one at least.
    Nothing but the cameras is moved.
    """
    least = max(1, round(least_share * len(ts)))
    own = curves.select(*_KEPT, F.explode("per_camera").alias("camera_id", "residual")).where(F.col("residual") <= most_residual).drop("residual")
    views = own.join(tables.rig(cameras).select("camera_id", *_LENS), "camera_id").withColumns({"source": F.lit("consensus"), "reason": F.lit(None).cast("string")})
    if missed is not None:
        views = views.unionByName(missed.withColumn("source", F.lit("gap")))
    seen = "p.x >= 0 AND p.x < width AND p.y >= 0 AND p.y < height"  # nan is beyond all numbers
    rows = views.withColumn("at", _pixels([C.basis(t) for t in ts], water_z))
    rows = rows.withColumn("points", F.expr(f"transform(transform(sequence(0, {len(ts) - 1}), i -> struct(at[2 * i] AS x, at[2 * i + 1] AS y)), p -> struct(p.x, p.y, {seen} AS seen))"))
    rows = rows.withColumn("visible", F.filter("points", lambda p: p["seen"]))
    rows = rows.where(F.size("visible") >= 2).withColumn("box", F.expr(G.principal_box("visible", pad)))
    score = G.confidence_score(F.col("mean_residual"), F.col("n_cameras"), F.col("spread"))
    n = F.size("visible").cast("long")
    return rows.select(*IMAGE, "fish_id", "source", "reason", n.alias("n_visible"), (n >= least).alias("posed"), obb_line(F.col("box"), F.col("width"), F.col("height")).alias("obb_line"),
                       score.alias("confidence"), "curvature", "n_cameras", "points", "box")


def _six(c: Column) -> Column:
    """Six places; nine first, so that a middle of a crop, which is a half there, doesn't hang on its last bit."""
    return F.format_string("%.6f", F.round(F.round(c, 9), 6))


def obb_line(box: Column, width: Column, height: Column, class_id: int = 0) -> Column:
    """``class x1 y1 ... x4 y4``: corners as parts of the image's size, to six places, not clipped."""
    return F.concat_ws(" ", F.lit(str(class_id)), *[_six(box[i][a] / size) for i in range(4) for a, size in (("x", width), ("y", height))])


def pose_line(box: Column, points: Column, width: int, height: int, class_id: int = 0) -> Column:
    """``class cx cy w h`` of the upright box around ``box``, then ``x y 2`` for each seen point and ``0 0 0`` for the others, in parts of the size, clipped to 0 and 1."""
    part = lambda c, size: _six(G.clip(c / size, 0.0, 1.0))
    ends = {a: [f(box.getField(a)) for f in (F.array_min, F.array_max)] for a in "xy"}
    sizes = {"x": float(width), "y": float(height)}
    head = [part((ends[a][0] + ends[a][1]) / 2, sizes[a]) for a in "xy"] + [part(ends[a][1] - ends[a][0], sizes[a]) for a in "xy"]
    triple = lambda p: F.when(p["seen"], F.concat_ws(" ", part(p["x"], sizes["x"]), part(p["y"], sizes["y"]), F.lit("2"))).otherwise("0 0 0")
    return F.concat_ws(" ", F.lit(str(class_id)), *head, F.transform(points, triple))


def images(labelled: DataFrame, tracks: DataFrame) -> DataFrame:
    """(frame_idx, camera_id, image, n_labels, n_tracked, complete, lines, confidence, report) of each image with a label, both sources together.

    An image is complete if no fewer are labelled than tracks are detected there,
    and only those should be written.  ``lines`` are in the order of fish;
    ``report`` is JSON of what the labels come from.  An image's labels are as many
    as its fish.
    """
    tracked = tracks.where("status = 'detected'").groupBy(*IMAGE).agg(F.count("*").alias("n_tracked"))
    cell = F.struct("fish_id", "source", "obb_line", "confidence", "reason", "n_cameras", "curvature")
    own = labelled.groupBy(*IMAGE).agg(F.count("*").alias("n_labels"), F.avg("confidence").alias("confidence"), F.array_sort(F.collect_list(cell)).alias("cells"))
    rows = own.join(tracked, IMAGE, "left").withColumn("n_tracked", F.coalesce("n_tracked", F.lit(0))).withColumn("complete", F.expr("n_tracked = 0 OR n_labels >= n_tracked"))
    name = F.format_string("%06d_%s", F.col("frame_idx").cast("long"), "camera_id")
    report = F.to_json(F.struct(F.expr("transform(cells, c -> struct(c.fish_id, c.source, c.confidence, c.reason AS gap_reason, IF(c.source = 'gap', c.n_cameras, NULL) AS n_source_cameras, c.curvature AS curvature_3d))").alias("labels"), F.col("n_tracked").alias("tracked_fish_count"), "complete"))
    return rows.select(*IMAGE, name.alias("image"), "n_labels", "n_tracked", "complete", F.array_join("cells.obb_line", "\n").alias("lines"), "confidence", report.alias("report"))


def crops(labelled: DataFrame, width: int = 128, height: int = 64, pad: float = 40.0, least: int = 2) -> DataFrame:
    """(frame_idx, camera_id, source, crop, fish_id, image, n_lines, lines): a crop around each posed fish, with a line for each fish of its image and source that shows ``least`` keypoints in it.

    The box of the crop's own fish becomes the crop, its long side across; points
    outside of it aren't seen there.  Crops are numbered by fish in their image;
    those in which nothing shows give no row, and leave their number out.
    """
    keys = [*IMAGE, "source"]
    fish = labelled.where("posed").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("fish_id", "points", "box"))).alias("fish"))
    each = fish.select(*keys, "fish", F.posexplode("fish").alias("crop", "own"))
    pairs = each.select(*keys, F.col("crop").cast("long").alias("crop"), F.col("own.fish_id").alias("fish_id"), F.col("own.box").alias("at"), F.posexplode("fish").alias("k", "other"))
    # Along the box's sides, as parts of them, times the size of the crop.
    along = lambda to: f"((p.x - at[0].x) * (at[{to}].x - at[0].x) + (p.y - at[0].y) * (at[{to}].y - at[0].y)) / (power(at[{to}].x - at[0].x, 2) + power(at[{to}].y - at[0].y, 2))"
    moved = pairs.withColumn("raw", F.expr(f"transform(other.points, p -> struct({along(1)} * {width - 1} AS x, {along(3)} * {height - 1} AS y, p.seen AS seen))"))
    inside = f"p.seen AND p.x >= 0 AND p.x < {width} AND p.y >= 0 AND p.y < {height}"
    held = lambda a, size: f"greatest(0D, least({size - 1}D, p.{a})) AS {a}"
    put = moved.withColumn("put", F.expr(f"transform(raw, p -> struct({held('x', width)}, {held('y', height)}, coalesce({inside}, false) AS seen))"))
    shown = put.withColumn("visible", F.filter("put", lambda p: p["seen"])).where(F.size("visible") >= least).withColumn("box", F.expr(G.principal_box("visible", pad)))
    line = pose_line(F.expr(G.clipped("box", width, height)), F.col("put"), width, height)
    rows = shown.select(*keys, "crop", "fish_id", "k", line.alias("line"))
    out = rows.groupBy(*keys, "crop", "fish_id").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("lines"))
    name = F.format_string("%06d_%s_%03d", F.col("frame_idx").cast("long"), "camera_id", "crop")
    return out.select(*keys, "crop", "fish_id", name.alias("image"), F.size("lines").cast("long").alias("n_lines"), F.array_join("lines.line", "\n").alias("lines"))


def summary(labelled: DataFrame, images_: DataFrame) -> DataFrame:
    """One row: (images, labels, mean_confidence, skipped, posed_consensus, posed_gap); confidence over the labels of complete images."""
    whole = F.col("complete")
    boxes = images_.agg(F.count_if(whole).alias("images"), F.coalesce(F.sum(F.when(whole, F.col("n_labels"))), F.lit(0)).alias("labels"),
                        F.coalesce(F.sum(F.when(whole, F.col("confidence") * F.col("n_labels"))) / F.sum(F.when(whole, F.col("n_labels"))), F.lit(0.0)).alias("mean_confidence"), F.count_if(~whole).alias("skipped"))
    posed = labelled.agg(*[F.count_if(F.col("posed") & (F.col("source") == s)).alias(f"posed_{s}") for s in ("consensus", "gap")])
    return boxes.crossJoin(F.broadcast(posed))  # one row each
