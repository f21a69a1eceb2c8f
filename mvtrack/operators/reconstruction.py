"""Reconstruction of points and curves from views: robust triangulation by pixel residuals, in numpy batches and as expressions.

A camera looks straight down through a flat surface: (fx, fy, cx, cy, px, py, pz),
a focal length each way, the centre of the image, and where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

CONTROL, DEGREE = 7, 3
CAMERA = ["fx", "fy", "cx", "cy", "px", "py", "pz"]
#: Pixels beyond which a camera is an outlier; cosine of the least angle of two cameras alone; share of the body that may lack at either end.
OUTLIER_PX = 10.0
LEAST_ANGLE = 5.0
END_GAP = 0.2


def project(points: np.ndarray, cameras: np.ndarray, water_z: float, n_air: float = 1.0, n_water: float = 1.333) -> np.ndarray:
    """Pixels (..., 2) of points (..., 3) in cameras (..., 7); nan at or above the surface.

    The radius at which the ray crosses the surface is found by ten Newton steps
    between 0 and the point's own radius.
    """
    fx, fy, cx, cy = (cameras[..., i] for i in range(4))
    d = points - cameras[..., 4:]
    r, depth, air = np.hypot(d[..., 0], d[..., 1]), points[..., 2] - water_z, water_z - cameras[..., 6]
    below = depth > 0
    safe = np.where(below, depth, 1.0)
    x = r * air / (air + safe)
    for _ in range(10):
        a, b = np.hypot(x, air), np.hypot(r - x, safe)
        f = n_air * x / a - n_water * (r - x) / b
        slope = n_air * air**2 / a**3 + n_water * safe**2 / b**3
        x = np.clip(x - f / slope, 0, r)
    scale = np.where(r > 0, x / np.where(r > 0, r, 1), 0) / air
    out = np.stack([cx + fx * d[..., 0] * scale, cy + fy * d[..., 1] * scale], axis=-1)
    return np.where(below[..., None], out, np.nan)


def cast(pixels: np.ndarray, cameras: np.ndarray, water_z: float, n_air: float = 1.0, n_water: float = 1.333) -> tuple[np.ndarray, np.ndarray]:
    """Origins on the surface and unit directions under it of pixels (..., 2)."""
    fx, fy, cx, cy = (cameras[..., i] for i in range(4))
    d = np.stack([(pixels[..., 0] - cx) / fx, (pixels[..., 1] - cy) / fy, np.ones(pixels.shape[:-1])], axis=-1)
    d /= np.linalg.norm(d, axis=-1, keepdims=True)
    origin = cameras[..., 4:] + d * ((water_z - cameras[..., 6]) / d[..., 2])[..., None]
    bent = d * (n_air / n_water)
    bent[..., 2] = np.sqrt(np.maximum(0, 1 - (n_air / n_water) ** 2 * (1 - d[..., 2] ** 2)))
    return origin, bent / np.linalg.norm(bent, axis=-1, keepdims=True)


def solved(o: np.ndarray, d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Points (n, 3) nearest to n sets of c weighted rays; nan where two rays or more don't fix one."""
    plane = np.eye(3) - d[..., :, None] * d[..., None, :]
    m = (w[..., None, None] * plane).sum(1)
    b = (w[..., None] * np.einsum("ncij,ncj->nci", plane, o)).sum(1)
    fine = ((w > 0).sum(1) >= 2) & (np.abs(np.linalg.det(m)) > 1e-12)
    p = np.full((len(o), 3), np.nan)
    if fine.any():
        p[fine] = np.linalg.solve(m[fine], b[fine][..., None])[..., 0]
    return p


def triangulate(pixels: np.ndarray, cameras: np.ndarray, confidence: np.ndarray, water_z: float, outlier_px: float = OUTLIER_PX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points (n, 3), pixel residuals (n, c) and kept cameras (n, c) of n points in c cameras each.

    Weighted by the root of confidence.  While a point has more than two cameras
    and the worst residual is beyond ``outlier_px``, that camera leaves and the
    point is solved again; so with two cameras it is kept whatever its residual.
    A camera that can't see the point is the worst.  Points of fewer than two
    cameras, or at or above the surface, are nan.  Nan pixels are no view.
    """
    keep = np.isfinite(pixels).all(-1)
    enough = keep.sum(1) >= 2
    seen = np.where(keep[..., None], pixels, 0.0)
    o, d = cast(seen, cameras, water_z)
    w = np.where(keep, np.sqrt(np.maximum(confidence, 0)), 0.0)
    point = solved(o, d, w)
    todo = np.flatnonzero(keep.sum(1) > 2)
    while len(todo):
        off = np.linalg.norm(project(point[todo, None], cameras[todo], water_z) - seen[todo], axis=-1)
        off = np.where(keep[todo], np.where(np.isnan(off), np.inf, off), -np.inf)
        worst = off.argmax(1)
        bad = off.max(1) > outlier_px
        todo, worst = todo[bad], worst[bad]
        keep[todo, worst] = False
        if len(todo):
            point[todo] = solved(o[todo], d[todo], np.where(keep[todo], w[todo], 0.0))
            todo = todo[keep[todo].sum(1) > 2]
    fine = enough & (point[:, 2] > water_z)
    point[~fine] = np.nan
    off = np.linalg.norm(project(point[:, None], cameras, water_z) - seen, axis=-1)
    return point, np.where(keep, off, np.nan), keep


_VIEW = ["point", "camera_id", *CAMERA, "u", "v", "confidence", "half_width"]


def _gathered(views: DataFrame) -> DataFrame:
    """A row a (frame_idx, fish_id), with its views in order of point and camera; bounded by cameras and body points."""
    cells = [F.col(c).cast({"point": "long", "camera_id": "string"}.get(c, "double")).alias(c) for c in _VIEW]
    return views.groupBy(F.col("frame_idx").cast("long").alias("frame_idx"), F.col("fish_id").cast("long").alias("fish_id")).agg(F.array_sort(F.collect_list(F.struct(*cells))).alias("views"))


def _padded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Rows of the batch and point numbers of all sets of views, and each attribute as (sets, cameras)."""
    lists = batch.column("views")
    rows = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    flat = lists.flatten()
    of = {c: flat.field(c) for c in _VIEW}
    number = np.asarray(of["point"])
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (number[1:] != number[:-1])
    start = np.flatnonzero(new)
    own = np.cumsum(new) - 1
    place = np.arange(len(rows)) - start[own] if len(rows) else own
    out = {}
    for c in _VIEW[1:]:
        values = np.asarray(of[c]) if c == "camera_id" else of[c].to_numpy(zero_copy_only=False)
        cells = np.full((len(start), int(place.max()) + 1 if len(place) else 0), None if c == "camera_id" else np.nan, object if c == "camera_id" else float)
        cells[own, place] = values
        out[c] = cells
    return rows[start], number[start], out


def _solve(of: dict[str, np.ndarray], water_z: float, outlier_px: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cameras = np.stack([of[c] for c in CAMERA], axis=-1)
    cameras = np.where(np.isnan(cameras), np.array([1.0, 1, 0, 0, 0, 0, 0]), cameras)
    confidence = np.where(np.isnan(of["confidence"]), 1.0, of["confidence"])
    return triangulate(np.stack([of["u"], of["v"]], axis=-1), cameras, confidence, water_z, outlier_px)


def robust_points(views: DataFrame, water_z: float, outlier_px: float = OUTLIER_PX) -> DataFrame:
    """(frame_idx, fish_id, point, x, y, z, n_cameras, mean_residual) of all body points that can be had (``triangulate``).

    ``views`` has (frame_idx, fish_id, point, camera_id), the camera (CAMERA), u,
    v, and confidence and half_width, which may be null: 1, and not known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, of = _padded(batch)
            point, off, keep = _solve(of, water_z, outlier_px)
            fine = np.isfinite(point).all(1)
            mean = np.nanmean(off[fine], axis=1) if fine.any() else np.zeros(0)
            cells = [batch.column(c).take(pa.array(rows[fine])) for c in ("frame_idx", "fish_id")] + [pa.array(x) for x in (number[fine].astype(np.int64), *point[fine].T, keep[fine].sum(1), mean)]
            yield pa.RecordBatch.from_arrays(cells, names=["frame_idx", "fish_id", "point", "x", "y", "z", "n_cameras", "mean_residual"])

    return _gathered(views).mapInArrow(run, "frame_idx long, fish_id long, point long, x double, y double, z double, n_cameras long, mean_residual double")


def one_shot_points(views: DataFrame, water_z: float, outlier_px: float = OUTLIER_PX, least_angle: float = LEAST_ANGLE) -> DataFrame:
    """Like ``robust_points``, by the plain rule: all cameras beyond the threshold leave at once, in expressions over one shuffle.

    Two cameras alone must look at an angle of ``least_angle`` degrees at least.
    Points are tried against the surface before and after; fewer than two cameras
    within the threshold give none.
    """
    keys = ["frame_idx", "fish_id", "point"]
    camera = {"fx": F.col("fx"), "fy": F.col("fy"), "cx": F.col("cx"), "cy": F.col("cy"), "centre": G.vec("px", "py", "pz"), "water_z": water_z}
    origin, bent = G.refract((F.col("u"), F.col("v")), **camera)
    rays = {**dict(zip(("ox", "oy", "oz"), origin, strict=True)), **dict(zip(("dx", "dy", "dz"), bent, strict=True))}
    # Dealt once, and before rays are cast, so that pixels are columns by then and not what they are computed from; all that follows keeps this dealing.
    dealt = views.select(*keys, *CAMERA, "u", "v", F.sqrt(F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(1.0)))).alias("w")).repartition(*keys)
    seen = dealt.where("u IS NOT NULL AND v IS NOT NULL AND NOT isnan(u) AND NOT isnan(v)").withColumns(rays)

    def solved_over(rows: DataFrame, least: Column) -> DataFrame:
        sums = G.triangulation_sums(G.vec("ox", "oy", "oz"), G.vec("dx", "dy", "dz"), F.col("w"))
        of = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(f"d{a}").alias(f"s{a}") for a in "xyz"], *sums).where(least)
        points = of.select(*keys, "n", *[c.alias(a) for a, c in zip("xyz", G.triangulated(), strict=True)]).where(F.col("z") > water_z)
        u, v = G.project(G.vec("x", "y", "z"), **camera)
        return rows.join(points, keys).withColumn("off", F.sqrt((u - F.col("u")) ** 2 + (v - F.col("v")) ** 2))

    # Of two unit vectors the square of the sum is 2 and twice the cosine.
    cosine = F.abs((F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2 - 2) / 2)
    first = solved_over(seen, (F.col("n") > 2) | ((F.col("n") == 2) & (cosine <= float(np.cos(np.radians(least_angle))))))
    kept = first.where(F.col("off") <= outlier_px).drop("x", "y", "z", "off", "n")
    last = solved_over(kept, F.col("n") >= 2)
    return last.groupBy(*keys, "x", "y", "z", F.col("n").alias("n_cameras")).agg(F.avg("off").alias("mean_residual"))


def nearest_points(rays: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, n, x, y, z): the point nearest to all rays (o, d) of a group, each counting the same.

    Groups of fewer than ``least`` rays have none, nor those whose rays are parallel
    or without a direction.  Sums combine before the shuffle.
    """
    sums = rays.groupBy(*keys).agg(F.count("*").alias("n"), *G.triangulation_sums(G.vec("ox", "oy", "oz"), G.vec("dx", "dy", "dz"), F.lit(1.0))).where(F.col("n") >= least)
    return sums.select(*keys, "n", *[c.alias(a) for a, c in zip("xyz", G.triangulated(), strict=True)]).where("x IS NOT NULL")


def knots(n: int = CONTROL) -> np.ndarray:
    return np.concatenate([np.zeros(DEGREE + 1), np.arange(1, n - DEGREE) / (n - DEGREE), np.ones(DEGREE + 1)])


def basis(u: np.ndarray, n: int = CONTROL) -> np.ndarray:
    """Values of the n cubic basis functions at u in 0 to 1."""
    t = knots(n)
    last = int(np.searchsorted(t, 1.0)) - 1
    at = np.clip(np.searchsorted(t, u, side="right") - 1, DEGREE, last)
    out = np.zeros((len(u), len(t) - 1))
    out[np.arange(len(u)), at] = 1.0
    for k in range(1, DEGREE + 1):
        left, right = t[k:-1] - t[: -k - 1], t[k + 1 :] - t[1:-k]
        a = np.divide(u[:, None] - t[: -k - 1], left, out=np.zeros((len(u), len(left))), where=left > 0)
        b = np.divide(t[k + 1 :] - u[:, None], right, out=np.zeros((len(u), len(right))), where=right > 0)
        out = a * out[:, :-1] + b * out[:, 1:]
    return out


def fit_curve(u: np.ndarray, points: np.ndarray, n: int = CONTROL) -> tuple[np.ndarray, float] | None:
    """Least-squares control points and arc length; None for too few points, uncovered ends or a singular fit."""
    if len(u) < n + 2 or u.min() > END_GAP or u.max() < 1 - END_GAP:
        return None
    b = basis(u, n)
    if np.linalg.matrix_rank(b) < n:
        return None
    control = np.linalg.lstsq(b, points, rcond=None)[0]
    fine = basis(np.linspace(0, 1, 1000), n) @ control
    return control, float(np.linalg.norm(np.diff(fine, axis=0), axis=1).sum())


def curves(points: DataFrame, keys: list[str]) -> DataFrame:
    """Control points (flat) and arc length of each group of (u, x, y, z); groups that can't be fitted have none."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("u")
        made = fit_curve(part["u"].to_numpy(float), part[["x", "y", "z"]].to_numpy(float))
        row = {k: [part[k].iloc[0]] for k in keys}
        return pd.DataFrame(row | {"control": [made[0].ravel()], "arc_length": [made[1]]} if made else {k: [] for k in [*keys, "control", "arc_length"]})

    types = dict(points.dtypes)
    return points.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", control array<double>, arc_length double")


SCHEMA = (
    "frame_idx long, fish_id long, control array<double>, arc_length double, half_widths array<double>, n_cameras long, mean_residual double, max_residual double, "
    "is_low_confidence boolean, per_camera map<string,double>, centroid_z double, z_offsets array<double>"
)


def _curve(number: np.ndarray, point: np.ndarray, keep: np.ndarray, of: dict[str, np.ndarray], n_points: int, water_z: float, flat: bool, least_points: int, weak_share: float) -> tuple | None:
    """One fish: (control, arc length, half widths, ...) from its points in order, or None."""
    fine = np.isfinite(point).all(1)
    if fine.sum() < least_points:
        return None
    u = number[fine] / (n_points - 1)
    if u[0] > END_GAP or u[-1] < 1 - END_GAP:
        return None
    p = point[fine].copy()
    depth = np.maximum(0, p[:, 2] - water_z)
    mean_z, offsets = None, None
    if flat:
        mean_z = float(p[:, 2].mean())
        offsets = np.full(n_points, np.nan)
        offsets[number[fine]] = p[:, 2] - mean_z
        p[:, 2] = mean_z
    made = fit_curve(u, p)
    if made is None:
        return None
    seen = np.isfinite(of["u"]) & np.isfinite(of["v"])
    wide = np.where(seen, of["half_width"], np.nan)[fine]
    known = np.isfinite(wide)
    pixels = np.where(known, wide, 0).sum(1) / np.maximum(known.sum(1), 1)  # over all cameras that see it
    first = keep[fine].argmax(1)  # the first camera that was kept tells the focal length
    focal = ((of["fx"] + of["fy"]) / 2)[fine][np.arange(fine.sum()), first]
    even = np.linspace(0, 1, n_points)
    widths = np.interp(even, u, pixels * depth / focal)
    curve = basis(even) @ made[0]
    errors: dict[str, list[float]] = {}
    cameras = np.stack([of[c] for c in CAMERA], axis=-1)
    off = np.linalg.norm(project(curve[number][:, None], cameras, water_z) - np.stack([of["u"], of["v"]], axis=-1), axis=-1)
    for c, e in zip(of["camera_id"].ravel(), off.ravel(), strict=True):
        if np.isfinite(e):
            errors.setdefault(c, []).append(float(e))
    every = [e for es in errors.values() for e in es]
    used = keep[fine].sum(1)
    per = {c: float(np.mean(es)) for c, es in sorted(errors.items())}
    weak = bool((used < 3).sum() > weak_share * len(used))
    return (
        made[0].ravel().tolist(), made[1], widths.tolist(), int(used.min()), float(np.mean(every)) if every else 0.0, float(np.max(every)) if every else 0.0, weak, list(per.items()), mean_z,
        None if offsets is None else [None if np.isnan(x) else float(x) for x in offsets],
    )


def reconstruct(views: DataFrame, n_points: int, water_z: float, outlier_px: float = OUTLIER_PX, flat: bool = True, least_points: int = CONTROL + 2, weak_share: float = 0.2) -> DataFrame:
    """A curve (SCHEMA) for each (frame_idx, fish_id) of ``views`` (see ``robust_points``), whose points are numbered from 0 to n_points - 1.

    All points of many fish are solved in one batch.  With ``flat`` they are put to
    their mean depth before the fit, and their offsets kept.  Half widths are means
    of pixels over all cameras that see a point, in metres by its depth and the
    focal length of the first kept camera, straight lines between points.
    Residuals are those of the fitted curve in all cameras.  A curve is of low
    confidence if more than ``weak_share`` of its points have fewer than three
    cameras.  Fish of too few points, without ends, or that can't be fitted, give
    no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, of = _padded(batch)
            point, _, keep = _solve(of, water_z, outlier_px)
            at, made = [], []
            for row in np.unique(rows):
                own = slice(*np.searchsorted(rows, [row, row + 1]))
                one = _curve(number[own], point[own], keep[own], {c: x[own] for c, x in of.items()}, n_points, water_z, flat, least_points, weak_share)
                if one is not None:
                    at.append(int(row))
                    made.append(one)
            names = ["control", "arc_length", "half_widths", "n_cameras", "mean_residual", "max_residual", "is_low_confidence", "per_camera", "centroid_z", "z_offsets"]
            numbers = pa.list_(pa.float64())
            types = [numbers, pa.float64(), numbers, pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.map_(pa.string(), pa.float64()), pa.float64(), numbers]
            cells = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("frame_idx", "fish_id")] + [pa.array([m[i] for m in made], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(cells, names=["frame_idx", "fish_id", *names])

    return _gathered(views).mapInArrow(run, SCHEMA)


def fill_curves(curves_: DataFrame, most_gap: int = 5) -> DataFrame:
    """``curves_`` with curves in between for gaps of up to ``most_gap`` frames of a fish: control points and lengths by straight lines, half widths of the one before, no cameras, low confidence."""
    w = Window.partitionBy("fish_id").orderBy("frame_idx")
    ahead = curves_.withColumn("after", F.lead(F.struct("frame_idx", "control", "arc_length")).over(w)).withColumn("gap", F.col("after.frame_idx") - F.col("frame_idx") - 1)
    made = ahead.where(f"gap BETWEEN 1 AND {most_gap}").withColumn("k", F.explode(F.expr("sequence(1L, gap)"))).withColumn("t", F.col("k") / (F.col("gap") + 1))
    new = made.select(
        (F.col("frame_idx") + F.col("k")).alias("frame_idx"), "fish_id", F.expr("zip_with(control, after.control, (a, b) -> (1 - t) * a + t * b)").alias("control"),
        F.expr("(1 - t) * arc_length + t * after.arc_length").alias("arc_length"), "half_widths", F.lit(0).cast("long").alias("n_cameras"), F.lit(0.0).alias("mean_residual"), F.lit(0.0).alias("max_residual"),
        F.lit(True).alias("is_low_confidence"), F.expr("CAST(map() AS map<string,double>)").alias("per_camera"), F.lit(None).cast("double").alias("centroid_z"), F.lit(None).cast("array<double>").alias("z_offsets"),
    )
    return curves_.unionByName(new)


def reconstruct_groups(tracks: DataFrame, midlines: DataFrame, cameras: DataFrame, n_points: int, water_z: float, least_cameras: int = 3, within: float = 5.0, most_gap: int = 5, **how) -> DataFrame:
    """The chain from tracks of known fish to curves by frame.

    ``tracks`` has (fish_id, camera_id, track_id, frame_idx, u, v, status), ``midlines``
    (frame_idx, camera_id, det_idx, u, v, points) of detections, points null or an
    array of (u, v, confidence, half_width), ``cameras`` (camera_id, CAMERA).  Of a
    fish's detected rows in a frame ``least_cameras`` are needed; each looks for
    the nearest detection with a midline within ``within`` pixels, the first on
    ties, and of a camera's several rows the last track's counts; as many cameras
    are needed again.  Then ``reconstruct`` and ``fill_curves``.
    """
    frame = Window.partitionBy("fish_id", "frame_idx")
    seen = tracks.where("status = 'detected'").withColumn("n", F.count("*").over(frame)).where(F.col("n") >= least_cameras)
    near = midlines.select("frame_idx", "camera_id", "det_idx", F.col("u").alias("mu"), F.col("v").alias("mv"), "points")
    far = F.sqrt((F.col("u") - F.col("mu")) ** 2 + (F.col("v") - F.col("mv")) ** 2)
    met = seen.join(near, ["frame_idx", "camera_id"]).withColumn("far", far).where(F.col("far") <= within)
    best = met.groupBy("fish_id", "frame_idx", "camera_id", "track_id").agg(F.min_by("points", F.struct("far", "det_idx")).alias("points"))
    one = best.where("points IS NOT NULL").groupBy("fish_id", "frame_idx", "camera_id").agg(F.max_by("points", "track_id").alias("points"))
    enough = one.withColumn("n", F.count("*").over(frame)).where(F.col("n") >= least_cameras)
    views = enough.join(cameras.select("camera_id", *CAMERA), "camera_id").select("frame_idx", "fish_id", "camera_id", *CAMERA, F.posexplode("points").alias("point", "p"))
    views = views.select("frame_idx", "fish_id", "point", "camera_id", *CAMERA, "p.u", "p.v", "p.confidence", "p.half_width")
    return fill_curves(reconstruct(views, n_points, water_z, **how), most_gap)
