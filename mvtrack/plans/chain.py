"""Registered queries of the chain from midlines to reconstruction and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curves as C
from ..functions import geometry as G
from ..operators import evaluation as E
from ..operators import matching, sequence
from ..sources import projections as P
from .queries import _ISLANDS, _NEAR, _POINTS, ORACLE_SQL, QUERIES, _points, query, r6

# -- midline sets ---------------------------------------------------------------------------------

_SAMPLED = (
    ", f AS (SELECT frame_idx, row_number() OVER (ORDER BY frame_idx) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT "
    "frame_idx FROM obs)), spine AS (SELECT frame_idx FROM f WHERE k IN (SELECT CAST(floor(i * (n - 1) / 39.0::DOUBLE) AS BIGINT) "
    "FROM (SELECT unnest(range(40)) AS i), (SELECT max(n) AS n FROM f)))"
)


@query(
    _SAMPLED
    + """, own AS (SELECT o.frame_idx, o.camera_id, o.track_id, o.track_id // 10 AS fish_id, u * 4 AS px, v AS py FROM obs o SEMI JOIN spine USING (frame_idx) WHERE status = 'detected'),
m AS (SELECT own.*, det_idx, confidence, sqrt((px - x - w / 2) * (px - x - w / 2) + (py - y - h / 2) * (py - y - h / 2)) AS dist FROM own JOIN det ON det.frame_idx = own.frame_idx % 500 AND det.camera_id = own.camera_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_idx, camera_id, track_id ORDER BY dist, det_idx DESC) AS k FROM m WHERE dist <= 400) WHERE k = 1 AND confidence >= 0.95),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_idx, fish_id, camera_id ORDER BY track_id DESC) AS j FROM best) WHERE j = 1)
SELECT spine.frame_idx, fish_id, camera_id, track_id, det_idx FROM spine LEFT JOIN one USING (frame_idx)""",
    "obs",
    "det",
)
def j7_midline_sets(spark, d):
    obs = P.observations(spark, d)
    spine = sequence.sampled_frames(obs, 40)
    groups = obs.select("camera_id", "track_id", F.expr("track_id div 10").alias("fish_id")).distinct()
    own = obs.where("status = 'detected'").select("frame_idx", "camera_id", "track_id", (F.col("u") * 4).alias("px"), F.col("v").alias("py"))
    midlines = P.detections(spark, d).withColumn("has_midline", F.col("confidence") >= 0.95)
    return E.midline_sets(own, groups, midlines, spine, 400.0, 500)


@query(_POINTS + _NEAR +
    " SELECT frame_idx, camera_id, point_id, det_idx FROM (SELECT *, row_number() OVER (PARTITION BY frame_idx, camera_id, point_id "
    "ORDER BY dist, det_idx) AS k FROM m WHERE dist < 10) WHERE k = 1", "obs", "det")
def j5_nearest_first_wins(spark, d):
    return matching.nearest(_points(spark, d), P.detections(spark, d), 10).select("frame_idx", "camera_id", "point_id", "det_idx")


@query(
    ", p AS (SELECT frame_idx % 500 AS frame_idx, camera_id, track_id, frame_idx AS f, u * 16 AS cx, v AS cy FROM obs) SELECT "
    "p.camera_id, p.track_id, p.f AS frame_idx, EXISTS (SELECT 1 FROM det b WHERE b.frame_idx = p.frame_idx AND b.camera_id = "
    "p.camera_id AND cx BETWEEN x AND x + 4 * w AND cy BETWEEN y AND y + 4 * h) AS inside FROM p", "obs", "det")
def p11_point_in_box(spark, d):
    """Points that lie in a box of their camera and frame: boxes and points meet by (frame, camera), bounds are inclusive."""
    points = P.observations(spark, d).select("camera_id", "track_id", "frame_idx", (F.col("frame_idx") % 500).alias("f"), (F.col("u") * 16).alias("cx"), F.col("v").alias("cy"))
    boxes = P.detections(spark, d).select(F.col("frame_idx").alias("bf"), F.col("camera_id").alias("bc"), "x", "y", "w", "h")
    hit = F.expr("f = bf AND camera_id = bc AND cx BETWEEN x AND x + 4 * w AND cy BETWEEN y AND y + 4 * h")
    inside = points.join(boxes, hit, "left_semi").withColumn("inside", F.lit(True))
    keys = ["camera_id", "track_id", "frame_idx"]
    return points.select(*keys).join(inside.select(*keys, "inside"), keys, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


# -- filters of points ----------------------------------------------------------------------------


@query(
    "SELECT frame_idx, camera_id, det_idx, CASE WHEN w * h < 100 THEN 'too_small' WHEN x <= 0 OR y <= 0 OR x + w >= 1600 OR y + h >= "
    "1200 THEN 'border' END AS reason FROM det", "det")
def p5_mask_check(spark, d):
    reason = F.when(F.col("w") * F.col("h") < 100, "too_small").when(F.expr("x <= 0 OR y <= 0 OR x + w >= 1600 OR y + h >= 1200"), "border")
    return P.detections(spark, d).select("frame_idx", "camera_id", "det_idx", reason.alias("reason"))


@query("SELECT vec_id, count(*) AS n_visible FROM pts WHERE i % 3 > 0 AND x >= 0 AND x < 0.2 AND y >= 0 AND y < 0.2 GROUP BY vec_id HAVING count(*) >= 2", "pts")
def p7_visible_in_image(spark, d):
    seen = "size(filter(points, (p, i) -> i % 3 > 0 AND p.x >= 0 AND p.x < 0.2 AND p.y >= 0 AND p.y < 0.2))"
    return P.polylines(spark, d).select("vec_id", F.expr(seen).cast("bigint").alias("n_visible")).where("n_visible >= 2")


@query("SELECT vec_id FROM pts GROUP BY vec_id HAVING sum(CAST(x >= 0 AND y >= 0 AS INT)) >= 0.5 * count(*) AND count(*) >= 2", "pts")
def p6_half_in_bounds(spark, d):
    inside = F.size(F.filter("points", lambda p: (p["x"] >= 0) & (p["y"] >= 0)))
    return P.polylines(spark, d).where((inside >= 0.5 * F.size("points")) & (F.size("points") >= 2)).select("vec_id")


_GATE = (
    ", r AS (SELECT frame_idx, camera_id, avg(w) AS residual FROM det GROUP BY ALL), c AS (SELECT DISTINCT frame_idx, 'cam_' || k AS "
    "camera_id FROM det, (SELECT unnest(range(10)) AS k))"
)


@query(_GATE + " SELECT c.frame_idx, c.camera_id FROM c JOIN r USING (frame_idx, camera_id) WHERE residual <= 25", "det")
def p8_camera_residual_gate(spark, d):
    """A camera passes if the reconstruction's map of residuals has it, within the threshold."""
    per = P.detections(spark, d).groupBy("frame_idx", "camera_id").agg(F.avg("w").alias("residual"))
    maps = per.groupBy("frame_idx").agg(F.map_from_entries(F.collect_list(F.struct("camera_id", "residual"))).alias("residuals"))
    asked = maps.select("frame_idx", "residuals", F.explode(F.expr("transform(sequence(0, 9), k -> concat('cam_', k))")).alias("camera_id"))
    return asked.where(F.expr("map_contains_key(residuals, camera_id) AND residuals[camera_id] <= 25")).select("frame_idx", "camera_id")


@query("SELECT ray_id, round(oz, 6) AS z FROM rays WHERE oz > 0.05", "rays")
def p12_below_surface(spark, d):
    return P.rays(spark, d).where("oz > 0.05").select("ray_id", F.round("oz", 6).alias("z"))


@query(
    ", b AS (SELECT label, vec_id, min(i / 31.0::DOUBLE) AS lo, max(i / 31.0::DOUBLE) AS hi, count(*) AS n FROM pts WHERE x > 0.02 "
    "GROUP BY ALL) SELECT vec_id FROM b WHERE lo <= 0.2 AND hi >= 0.8 AND n >= 9", "pts")
def p13_endpoints_covered(spark, d):
    rows = P.polylines(spark, d).select("vec_id", F.posexplode("points").alias("i", "p")).where("p.x > 0.02")
    b = rows.groupBy("vec_id").agg((F.min("i") / 31).alias("lo"), (F.max("i") / 31).alias("hi"), F.count("*").alias("n"))
    return b.where("lo <= 0.2 AND hi >= 0.8 AND n >= 9").select("vec_id")


# -- projection -----------------------------------------------------------------------------------

_ZERO = (F.lit, 0.0)
_CAMERA = {"fx": 1400.0, "cx": 800.0, "cy": 600.0, "water_z": 0.75}


def _centre():
    return (F.lit(0.0),) * 3


def _newton(r: str, depth: str, air: str) -> str:
    step = f"greatest(0, least({r}, x - (x / sqrt(x*x + {air}*{air}) - 1.333::DOUBLE * ({r} - x) / sqrt(({r} - x)*({r} - x) + {depth}*{depth})) / ({air}*{air} / pow(sqrt(x*x + {air}*{air}), 3) + 1.333::DOUBLE * {depth}*{depth} / pow(sqrt(({r} - x)*({r} - x) + {depth}*{depth}), 3))))"
    return f"list_reduce(list_prepend({r} * {air} / ({air} + {depth}), CAST([0, 0, 0, 0, 0, 0, 0, 0, 0, 0] AS DOUBLE[])), lambda x, k: {step})"


@query(f", q AS (SELECT ray_id, ox, oy, abs(oz) + 0.8::DOUBLE - 0.75::DOUBLE AS depth, sqrt(ox*ox + oy*oy) AS r, 0.75::DOUBLE AS air FROM rays), s AS (SELECT *, {_newton('r', 'depth', 'air')} / r / air AS scale FROM q) SELECT ray_id, round(800 + 1400 * ox * scale, 6) AS u, round(600 + 1400 * oy * scale, 6) AS v FROM s", "rays")
def f5_project(spark, d):
    points = P.rays(spark, d).withColumn("oz", F.abs("oz") + 0.8)
    u, v = G.project(G.vec("ox", "oy", "oz"), centre=_centre(), **_CAMERA)
    return points.select("ray_id", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query(f", q AS (SELECT ray_id, ox, oy, abs(oz) + 0.8::DOUBLE - 0.75::DOUBLE AS depth, sqrt(ox*ox + oy*oy) AS r, 0.75::DOUBLE AS air FROM rays), s AS (SELECT *, {_newton('r', 'depth', 'air')} / r / air AS scale FROM q) SELECT ray_id FROM s WHERE 800 + 1400 * ox * scale >= 750 AND 800 + 1400 * ox * scale < 900 AND 600 + 1400 * oy * scale >= 550 AND 600 + 1400 * oy * scale < 700", "rays")
def p15_visible_in_image(spark, d):
    points = P.rays(spark, d).withColumn("oz", F.abs("oz") + 0.8)
    u, v = G.project(G.vec("ox", "oy", "oz"), centre=_centre(), **_CAMERA)
    return points.select("ray_id", u.alias("u"), v.alias("v")).where("u >= 750 AND u < 900 AND v >= 550 AND v < 700").select("ray_id")


_TS = [k / 9 for k in range(10)]
_BASIS = ", basis(k, j, w) AS (VALUES " + ", ".join(f"({k}, {j}, {w!r}::DOUBLE)" for k, t in enumerate(_TS) for j, w in enumerate(C.basis(t)) if w) + ")"
_CP = (
    ", cp AS (SELECT vec_id, j, CAST(embedding[3 * j + 1] AS DOUBLE) AS x, CAST(embedding[3 * j + 2] AS DOUBLE) AS y, "
    "abs(CAST(embedding[3 * j + 3] AS DOUBLE)) + 0.8::DOUBLE AS z FROM embeddings, (SELECT unnest(range(7)) AS j)), curve AS (SELECT "
    "vec_id, CAST(k AS BIGINT) AS k, sum(w * x) AS x, sum(w * y) AS y, sum(w * z) AS z FROM cp JOIN basis USING (j) GROUP BY ALL)"
)


def _curves(spark, d):
    cp = (
        "transform(sequence(0, 6), j -> struct(cast(embedding[3 * j] AS double) AS x, cast(embedding[3 * j + 1] AS double) AS y, "
        "abs(cast(embedding[3 * j + 2] AS double)) + 0.8D AS z))"
    )
    rows = P.read(spark, d, "embeddings").select("vec_id", F.col("label").alias("fish_id"), F.expr(cp).alias("cp"))
    curve = C.evaluated(F.col("cp"), ["x", "y", "z"], _TS)
    return rows.select("vec_id", "fish_id", F.posexplode(curve).alias("k", "p")).select("vec_id", "fish_id", F.col("k").cast("bigint").alias("k"), "p.*")


@query("WITH vals AS (SELECT 1)" + _BASIS + _CP + " SELECT vec_id, k, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM curve")
def f12_spline_points(spark, d):
    return _curves(spark, d).select("vec_id", "k", r6("x"), r6("y"), r6("z"))


_PIXELS = f", pix AS (SELECT vec_id, k, z, 800 + 1400 * x * scale AS u, 600 + 1400 * y * scale AS v FROM (SELECT *, {_newton('r', 'depth', 'air')} / r / air AS scale FROM (SELECT *, z - 0.75::DOUBLE AS depth, sqrt(x*x + y*y) AS r, 0.75::DOUBLE AS air FROM curve)))"


def _pixels(spark, d):
    u, v = G.project(G.vec("x", "y", "z"), centre=_centre(), **_CAMERA)
    return _curves(spark, d).withColumns({"u": u, "v": v})


@query("WITH vals AS (SELECT 1)" + _BASIS + _CP + _PIXELS + " SELECT vec_id, k, round(u, 5) AS u, round(v, 5) AS v, u >= 700 AND u < 900 AND v >= 500 AND v < 700 AS visible FROM pix")
def f11_reprojected_keypoints(spark, d):
    return _pixels(spark, d).select("vec_id", "k", F.round("u", 5).alias("u"), F.round("v", 5).alias("v"), F.expr("u >= 700 AND u < 900 AND v >= 500 AND v < 700").alias("visible"))


@query("WITH vals AS (SELECT 1)" + _BASIS + _CP + _PIXELS +
    " SELECT vec_id, count(*) AS n, round(avg(u), 5) AS u, round(avg(v), 5) AS v FROM pix WHERE u >= 700 AND u < 900 AND v >= 500 "
    "AND v < 700 GROUP BY vec_id HAVING count(*) >= 2"
)
def f13_reprojected_midlines(spark, d):
    """Curves in the image; what falls outside is dropped, and a curve of fewer than two points is none."""
    rows = _pixels(spark, d).where("u >= 700 AND u < 900 AND v >= 500 AND v < 700")
    return rows.groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.avg("u"), 5).alias("u"), F.round(F.avg("v"), 5).alias("v")).where("n >= 2")


# -- resampling -----------------------------------------------------------------------------------

_ARC = (
    ", st AS (SELECT vec_id, i, x, y, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) "
    "OVER w)), 0) AS step FROM pts WINDOW w AS (PARTITION BY vec_id ORDER BY i)), c AS (SELECT vec_id, i, x, y, sum(step) OVER "
    "(PARTITION BY vec_id ORDER BY i) / sum(step) OVER (PARTITION BY vec_id) AS t FROM st), q AS (SELECT unnest(range(1, 9)) AS k)"
)


@query(_ARC +
    ", s AS (SELECT c.*, k, k / 9.0::DOUBLE AS q, row_number() OVER (PARTITION BY vec_id, k ORDER BY i DESC) AS rk FROM c, q WHERE t "
    "<= k / 9.0::DOUBLE AND i < 31) SELECT s.vec_id, k, round(s.x + (q - s.t) / (n.t - s.t) * (n.x - s.x), 6) AS x, round(s.y + (q - "
    "s.t) / (n.t - s.t) * (n.y - s.y), 6) AS y FROM s JOIN c n ON n.vec_id = s.vec_id AND n.i = s.i + 1 WHERE rk = 1", "pts")
def w11_resample(spark, d):
    """Midlines at even arc lengths, between their ends."""
    rows = P.polylines(spark, d).select("vec_id", "points", F.expr(C.arc_lengths("points")).alias("t"))
    rows = rows.select("vec_id", "t", F.col("points.x").alias("xs"), F.col("points.y").alias("ys"), F.explode(F.expr("sequence(1L, 8L)")).alias("k")).withColumn("q", F.col("k") / 9)
    return rows.select("vec_id", "k", *[F.round(F.expr(C.interpolated("q", "t", f"{c}s")), 6).alias(c) for c in "xy"])


_KEYPOINTS = (
    ", kp AS (SELECT vec_id, i / 11.0::DOUBLE AS t, x, y, abs(x) AS conf, row_number() OVER (PARTITION BY vec_id ORDER BY i) AS r, "
    "count(*) OVER (PARTITION BY vec_id) AS n FROM pts WHERE i < 12 AND y > -0.1), q AS (SELECT k, k / 9.0::DOUBLE AS q FROM (SELECT "
    "unnest(range(10)) AS k)), s AS (SELECT vec_id, k, q, least(greatest(count(*) FILTER (t <= q), 1), max(n) - 1) AS r, min(t) AS "
    "lo, max(t) AS hi FROM kp, q GROUP BY ALL HAVING max(n) >= 2), z AS (SELECT s.*, a.t AS t0, b.t AS t1, a.x AS x0, b.x AS x1, a.y "
    "AS y0, b.y AS y1, a.conf AS c0, b.conf AS c1, least(greatest(q, lo), hi) AS h FROM s JOIN kp a ON a.vec_id = s.vec_id AND a.r = "
    "s.r JOIN kp b ON b.vec_id = s.vec_id AND b.r = s.r + 1)"
)


def _keypoints(spark, d):
    kp = "filter(transform(slice(points, 1, 12), (p, i) -> struct(i / 11D AS t, p.x AS x, p.y AS y, abs(p.x) AS conf)), p -> p.y > -0.1)"
    rows = P.polylines(spark, d).select("vec_id", F.expr(kp).alias("kp")).where("size(kp) >= 2")
    return rows.select("vec_id", *[F.col(f"kp.{c}").alias(f"{c}s") for c in ("t", "x", "y", "conf")], F.explode(F.expr("sequence(0L, 9L)")).alias("k")).withColumn("q", F.col("k") / 9)


@query(_KEYPOINTS +
    " SELECT vec_id, k, round(x0 + (q - t0) / (t1 - t0) * (x1 - x0), 6) AS x, round(y0 + (q - t0) / (t1 - t0) * (y1 - y0), 6) AS y, "
    "round(c0 + (h - t0) / (t1 - t0) * (c1 - c0), 6) AS conf FROM z", "pts")
def w12_keypoints_to_midline(spark, d):
    """Positions go on beyond the outer keypoints along the last line; confidences stay."""
    made = [F.round(F.expr(C.interpolated("q", "ts", f"{c}s", c != "conf")), 6).alias(c) for c in ("x", "y", "conf")]
    return _keypoints(spark, d).select("vec_id", "k", *made)


@query(_KEYPOINTS + " SELECT vec_id, k, round((c0 + (h - t0) / (t1 - t0) * (c1 - c0)) * 0.9 / 1400, 9) AS half_width FROM z", "pts")
def w13_half_widths(spark, d):
    """Half widths in metres along the curve: pixels at the kept points, by depth and focal length, then straight lines with held ends."""
    rows = _keypoints(spark, d).withColumn("metres", F.transform("confs", lambda c: G.half_width_metres(c, F.lit(0.9), F.lit(1400.0))))
    return rows.select("vec_id", "k", F.round(F.expr(C.interpolated("q", "ts", "metres")), 9).alias("half_width"))


ORACLE_SQL["f10_half_widths_of_inliers"] = (
        "WITH det AS (SELECT l_orderkey % 500 AS frame_idx, 'cam_' || (l_suppkey % 8) AS camera_id, l_quantity AS w, l_tax AS "
        "residual FROM lineitem), cams AS (SELECT 'cam_' || k AS camera_id, 1400 + 10 * k AS focal FROM (SELECT unnest(range(8)) AS "
        "k)), first AS (SELECT frame_idx, min(camera_id) AS camera_id, avg(w) AS w FROM det WHERE residual <= 0.04 GROUP BY "
        "frame_idx) SELECT frame_idx, camera_id, round(w * 0.9 / focal, 9) AS half_width FROM first JOIN cams USING (camera_id)"

)


def f10_half_widths_of_inliers(spark, d):
    """A point's half width in metres, by the focal length of its first camera that was not rejected."""
    det = P.read(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("frame_idx"), F.concat(F.lit("cam_"), (F.col("l_suppkey") % 8).cast("string")).alias("camera_id"), F.col("l_quantity").alias("w"), F.col("l_tax").alias("residual"))
    cams = spark.range(8).select(F.concat(F.lit("cam_"), F.col("id").cast("string")).alias("camera_id"), (1400 + 10 * F.col("id")).cast("double").alias("focal"))
    first = det.where("residual <= 0.04").groupBy("frame_idx").agg(F.min("camera_id").alias("camera_id"), F.avg("w").alias("w"))
    return first.join(F.broadcast(cams), "camera_id").select("frame_idx", "camera_id", F.round(G.half_width_metres(F.col("w"), F.lit(0.9), F.col("focal")), 9).alias("half_width"))


QUERIES["f10_half_widths_of_inliers"] = f10_half_widths_of_inliers


# -- evaluation -----------------------------------------------------------------------------------


@query(
    ", c AS (SELECT track_id AS fish_id, frame_idx, avg(u) AS x, avg(v) AS y FROM obs GROUP BY ALL), s AS (SELECT fish_id, sqrt((x - "
    "lag(x) OVER q) * (x - lag(x) OVER q) + (y - lag(y) OVER q) * (y - lag(y) OVER q)) AS st FROM c WINDOW q AS (PARTITION BY "
    "fish_id ORDER BY frame_idx)), m AS (SELECT avg(step) AS step FROM (SELECT coalesce(avg(st), 0) AS step FROM s GROUP BY "
    "fish_id)), k AS (SELECT CASE WHEN vec_id % 4 = 0 THEN 1::DOUBLE ELSE abs(x) END AS conf FROM pts) SELECT round(avg(conf), 6) AS "
    "mean_confidence, round(stddev_pop(conf), 6) AS std_confidence, round(avg(CAST(conf > 0.1 AS INT)), 6) AS completeness, (SELECT "
    "round(step, 6) FROM m) AS smoothness FROM k", "obs", "pts")
def a6_midline_metrics(spark, d):
    """Midlines without confidences count as sure in every point."""
    midlines = P.polylines(spark, d).select(F.when(F.col("vec_id") % 4 > 0, F.transform("points", lambda p: F.abs(p["x"]))).alias("confidences"), F.size("points").alias("n"))
    centroids = P.observations(spark, d).select(F.col("track_id").alias("fish_id"), "frame_idx", F.col("u").alias("x"), F.col("v").alias("y"))
    return E.midline_metrics(midlines, centroids, 0.1)


_TIERS = ", r AS (SELECT frame_idx, frame_idx % 20 AS fish_id, camera_id, w AS residual, h > 20 AS low, CASE WHEN x > 800 THEN abs(y - 600) / 100 END AS moved FROM det)"


@query(_TIERS +
    " SELECT round(avg(residual), 6) AS mean_residual, max(residual) AS max_residual, round(avg(CAST(low AS INT)), 6) AS "
    "low_confidence_rate, round(1 - coalesce(avg(CAST(low AS INT)), 0), 6) AS inlier_ratio, round(max(moved), 6) AS max_displacement "
    "FROM r", "det")
def a8_reconstruction_metrics(spark, d):
    rows = P.detections(spark, d).select(F.col("w").alias("residual"), (F.col("h") > 20).alias("is_low"), F.expr("CASE WHEN x > 800 THEN abs(y - 600) / 100 END").alias("displacement"))
    return E.reconstruction_metrics(rows)


_NOISE = (
    ", z AS (SELECT label AS fish_id, vec_id AS frame_idx, i, y AS z FROM pts), rg AS (SELECT fish_id, median(g) AS z_range FROM "
    "(SELECT fish_id, frame_idx, max(z) - min(z) AS g FROM z GROUP BY ALL) GROUP BY fish_id), df AS (SELECT fish_id, frame_idx, i, z "
    "- lag(z) OVER (PARTITION BY fish_id, i ORDER BY frame_idx) AS dz FROM z), rm AS (SELECT fish_id, avg(rms) AS rms FROM (SELECT "
    "fish_id, frame_idx, sqrt(avg(dz * dz)) AS rms FROM df WHERE dz IS NOT NULL GROUP BY ALL) GROUP BY fish_id), sg AS (SELECT "
    "fish_id, stddev_pop(m) AS signal FROM (SELECT fish_id, i, avg(z) AS m FROM z GROUP BY ALL) GROUP BY fish_id), ns AS (SELECT "
    "fish_id, stddev_pop(dz) AS noise FROM df WHERE dz IS NOT NULL GROUP BY fish_id), per AS (SELECT fish_id, z_range, rms, CASE "
    "WHEN noise > 1e-12 THEN signal / noise ELSE 0 END AS snr FROM rg JOIN rm USING (fish_id) JOIN sg USING (fish_id) JOIN ns USING "
    "(fish_id))"
)


@query(_NOISE + " SELECT fish_id, round(z_range, 6) AS z_range, round(rms, 6) AS rms, round(snr, 6) AS snr FROM per", "pts")
def a9_z_denoising(spark, d):
    return E.z_denoising(_profiles(spark, d)).select("fish_id", r6("z_range"), r6("rms"), r6("snr"))


@query(_NOISE +
    " SELECT round(median(z_range) * 100, 5) AS median_range_cm, round(avg(rms) * 100, 5) AS mean_rms_cm, round(avg(snr), 5) AS "
    "mean_snr, count(*) FILTER (snr > 1) AS n_clear FROM per", "pts")
def a9_z_denoising_overall(spark, d):
    per = E.z_denoising(_profiles(spark, d))
    return per.agg(F.round(F.expr("percentile(z_range, 0.5)") * 100, 5).alias("median_range_cm"), F.round(F.avg("rms") * 100, 5).alias("mean_rms_cm"), F.round(F.avg("snr"), 5).alias("mean_snr"), F.count_if(F.col("snr") > 1).alias("n_clear"))


def _profiles(spark, d):
    rows = P.polylines(spark, d)
    return rows.select(F.col("label").alias("fish_id"), F.col("vec_id").alias("frame_idx"), F.posexplode("points").alias("i", "p")).select("fish_id", "frame_idx", "i", F.col("p.y").alias("z"))


_CENTROID = f""", s AS (SELECT camera_id, track_id // 10 AS fish_id, frame_idx, u / 1000 AS x, v / 1000 AS y FROM obs WHERE status = 'detected'), c AS (SELECT fish_id, frame_idx, avg(x) AS cx, avg(y) AS cy FROM s GROUP BY ALL HAVING count(*) >= 2), k AS (SELECT s.*, cx + 0.01::DOUBLE AS px, cy + 0.01::DOUBLE AS py, 0.25::DOUBLE AS depth, 0.75::DOUBLE AS air, sqrt((cx + 0.01::DOUBLE) * (cx + 0.01::DOUBLE) + (cy + 0.01::DOUBLE) * (cy + 0.01::DOUBLE)) AS r FROM s JOIN c USING (fish_id, frame_idx)), e AS (SELECT *, {_newton('r', 'depth', 'air')} / r / air AS scale FROM k), res AS (SELECT camera_id, fish_id, frame_idx, sqrt(pow(1400 * px * scale - 1400 * x, 2) + pow(1400 * py * scale - 1400 * y, 2)) AS residual FROM e)"""


@query(_CENTROID +
    " SELECT camera_id, fish_id, round(avg(residual), 5) AS mean_residual, round(max(residual), 5) AS max_residual, count(DISTINCT "
    "frame_idx) AS frames FROM res GROUP BY GROUPING SETS ((), (camera_id), (fish_id))", "obs")
def a10_centroid_reprojection(spark, d):
    """Residuals of projected consensus points: over all, by camera and by fish, in one pass of grouping sets."""
    seen = P.observations(spark, d).where("status = 'detected'").select("camera_id", F.expr("track_id div 10").alias("fish_id"), "frame_idx", (F.col("u") / 1000).alias("x"), (F.col("v") / 1000).alias("y"))
    return E.centroid_reprojection(seen, _CAMERA, _centre())


@query(
    ", r AS (SELECT *, ray_id // 6 AS fish FROM rays), c AS (SELECT fish, avg(ox) AS cx, avg(oy) AS cy, avg(oz) AS cz FROM r GROUP "
    "BY fish HAVING count(*) >= 4), ds AS (SELECT r.fish, camera_id, ray_id, sqrt(greatest(0, "
    "(cx-ox)*(cx-ox)+(cy-oy)*(cy-oy)+(cz-oz)*(cz-oz) - pow((cx-ox)*dx+(cy-oy)*dy+(cz-oz)*dz, 2)/(dx*dx+dy*dy+dz*dz))) AS dist FROM r "
    "LEFT JOIN c USING (fish)) SELECT fish, camera_id, round(coalesce(median(dist), 'Infinity'::DOUBLE), 5) AS distance FROM (SELECT "
    "fish, camera_id, CASE WHEN fish IN (SELECT fish FROM c) THEN dist END AS dist FROM ds) GROUP BY ALL", "rays")
def a12_tracklet_distances(spark, d):
    """The median distance of each tracklet's rays from the group's consensus; without one, beyond any bound."""
    rays = P.rays(spark, d).withColumn("fish", F.expr("ray_id div 6"))
    c = rays.groupBy("fish").agg(*[F.avg(f"o{a}").alias(f"c{a}") for a in "xyz"], F.count("*").alias("n")).where("n >= 4").drop("n")
    dist = F.when(F.col("cx").isNotNull(), G.point_line_distance(G.vec("cx", "cy", "cz"), G.vec("ox", "oy", "oz"), G.vec("dx", "dy", "dz")))
    rows = rays.join(c, "fish", "left").select("fish", "camera_id", dist.alias("dist"))
    return rows.groupBy("fish", "camera_id").agg(F.round(F.coalesce(F.expr("percentile(dist, 0.5)"), F.lit(float("inf"))), 5).alias("distance"))


@query(", q AS (SELECT camera_id, count(*) AS n, sum(ox) AS s FROM rays GROUP BY camera_id) SELECT camera_id FROM q WHERE n >= 2", "rays")
def a19_enough_rays(spark, d):
    """Points need two rays at least: the others are an error of the caller."""
    return P.rays(spark, d).groupBy("camera_id").agg(F.count("*").alias("n")).where("n >= 2").select("camera_id")


# -- uncertainty and lookup tables ----------------------------------------------------------------

_RIG = (
    "cams AS (SELECT c AS camera_id, (c % 3 - 1) * 0.4::DOUBLE AS px, (c // 3 - 1) * 0.4::DOUBLE AS py FROM (SELECT unnest(range(9)) "
    "AS c)), depths AS (SELECT k, 1.0::DOUBLE + 0.05::DOUBLE * k AS z FROM (SELECT unnest(range(20)) AS k))"
)
_LUT = (
    ", lut AS (SELECT gx, gy, 0.75::DOUBLE*ax AS ox, 0.75::DOUBLE*ay AS oy, bx / sqrt(bx*bx+by_*by_+bz*bz) AS dx, by_ / "
    "sqrt(bx*bx+by_*by_+bz*bz) AS dy, bz / sqrt(bx*bx+by_*by_+bz*bz) AS dz FROM (SELECT *, k*ax/l AS bx, k*ay/l AS by_, "
    "sqrt(greatest(0, 1 - k*k*(1 - 1/(l*l)))) AS bz FROM (SELECT *, sqrt(ax*ax+ay*ay+1) AS l, 1.0::DOUBLE / 1.333::DOUBLE AS k FROM "
    "(SELECT gx, gy, (gx * 100 - 800) / 1400.0::DOUBLE AS ax, (gy * 100 - 600) / 1400.0::DOUBLE AS ay FROM (SELECT unnest(range(17)) "
    "AS gx), (SELECT unnest(range(13)) AS gy)))))"
)


_LOOKED = _LUT + (
    ", p AS (SELECT frame_idx, camera_id, det_idx, x, y, least(greatest(CAST(floor(x / 100) AS BIGINT), 0), 15) AS gx, "
    "least(greatest(CAST(floor(y / 100) AS BIGINT), 0), 11) AS gy FROM det), b AS (SELECT p.*, x / 100 - p.gx AS fx, y / 100 - p.gy "
    "AS fy, "
) + ", ".join(f"l{i}{j}.d{a} AS d{a}{i}{j}" for i in (0, 1) for j in (0, 1) for a in "xyz") + " FROM p " + " ".join(f"JOIN lut l{i}{j} ON l{i}{j}.gx = p.gx + {i} AND l{i}{j}.gy = p.gy + {j}" for i in (0, 1) for j in (0, 1)) + "), c AS (SELECT frame_idx, camera_id, det_idx, x, y, " + ", ".join(f"(1-fx)*(1-fy)*d{a}00 + fx*(1-fy)*d{a}10 + (1-fx)*fy*d{a}01 + fx*fy*d{a}11 AS d{a}" for a in "xyz") + " FROM b)"


@query(_LOOKED + " SELECT frame_idx, camera_id, det_idx, " + ", ".join(f"round(d{a} / sqrt(dx*dx+dy*dy+dz*dz), 6) AS d{a}" for a in "xyz") + " FROM c", "det")
def f6_table_cast(spark, d):
    """Directions by bilinear lookup: the table is as small as its grid, so its four corners are broadcast."""
    return E.table_cast(P.detections(spark, d), E.forward_table(spark, _CAMERA, 1600, 1200, 100), 100, 16, 12).select("frame_idx", "camera_id", "det_idx", *[r6(f"d{a}") for a in "xyz"])


@query(_LOOKED +
    ", e AS (SELECT *, dx / sqrt(dx*dx+dy*dy+dz*dz) AS ux, dy / sqrt(dx*dx+dy*dy+dz*dz) AS uy, dz / sqrt(dx*dx+dy*dy+dz*dz) AS uz, "
    "(x - 800) / 1400.0::DOUBLE AS ax, (y - 600) / 1400.0::DOUBLE AS ay FROM c), t AS (SELECT *, ax / sqrt(ax*ax+ay*ay+1) / 1.333 AS "
    "bx, ay / sqrt(ax*ax+ay*ay+1) / 1.333 AS by_, sqrt(1 - (1 - 1 / (ax*ax+ay*ay+1)) / (1.333::DOUBLE * 1.333::DOUBLE)) AS bz FROM "
    "e) SELECT round(max(2 * degrees(asin(sqrt(pow(ux-bx,2)+pow(uy-by_,2)+pow(uz-bz,2)) / 2))), 5) AS max_degrees, round(avg(2 * "
    "degrees(asin(sqrt(pow(ux-bx,2)+pow(uy-by_,2)+pow(uz-bz,2)) / 2))), 5) AS mean_degrees FROM t", "det")
def a31_table_error(spark, d):
    """The largest and mean angle between looked-up and exact directions."""
    looked = E.table_cast(P.detections(spark, d), E.forward_table(spark, _CAMERA, 1600, 1200, 100), 100, 16, 12)
    _, exact = G.refract((F.col("x"), F.col("y")), _CAMERA["fx"], _CAMERA["cx"], _CAMERA["cy"], _centre(), _CAMERA["water_z"])
    apart = G.norm(G.sub(G.vec("dx", "dy", "dz"), exact))
    angle = 2 * F.degrees(F.asin(apart / 2))
    return looked.select(angle.alias("a")).agg(F.round(F.max("a"), 5).alias("max_degrees"), F.round(F.avg("a"), 5).alias("mean_degrees"))


# -- shifts and orientation -----------------------------------------------------------------------


@query(_ISLANDS +
    ", f AS (SELECT m.camera_id, m.track_id, m.frame_idx, any_value(m.u) AS u, sum(w * q.u) AS smoothed FROM m JOIN p q ON q.camera_id = m.camera_id AND q.track_id = m.track_id AND q.island = m.island "
    "AND q.pos = CASE WHEN spot < m.n THEN spot ELSE 2 * m.n - 1 - spot END GROUP BY ALL) "
    "SELECT camera_id, track_id, frame_idx, j, round(u + j * 0.1::DOUBLE + smoothed - u, 5) AS z FROM f, (SELECT unnest(range(7)) AS j)", "obs")
def w2_shift_control_points(spark, d):
    """Every control point of a curve moves by what the filter of its island (w1) moved its centroid."""
    rows = sequence.smooth(P.observations(spark, d), sequence.TRACK, "u").withColumn("shift", F.col("smoothed") - F.col("u"))
    rows = rows.withColumn("z", F.expr("transform(sequence(0, 6), j -> u + j * 0.1D)"))
    moved = rows.select("camera_id", "track_id", "frame_idx", F.posexplode(F.expr("transform(z, v -> v + shift)")).alias("j", "z"))
    return moved.withColumn("j", F.col("j").cast("bigint")).withColumn("z", F.round("z", 5))


_VOTES = (
    ", h AS (SELECT vec_id, label AS fish_id, vec_id AS frame_idx, max(x) FILTER (i = 0) - max(x) FILTER (i = 31) AS hx, max(y) "
    "FILTER (i = 0) - max(y) FILTER (i = 31) AS hy, avg(x) AS cx, avg(y) AS cy, max(x) FILTER (i = 3) AS g FROM pts GROUP BY ALL), v "
    "AS (SELECT *, cx - lag(cx) OVER w AS vx, cy - lag(cy) OVER w AS vy, row_number() OVER w AS n FROM h WINDOW w AS (PARTITION BY "
    "fish_id ORDER BY frame_idx)), s AS (SELECT *, CASE WHEN g > 0 THEN 1 ELSE -1 END AS geometric, CASE WHEN vx IS NULL OR "
    "sqrt(vx*vx + vy*vy) < 0.01 OR sqrt(hx*hx + hy*hy) < 1e-9 THEN 0 WHEN hx*vx + hy*vy > 0 THEN 1 ELSE -1 END AS velocity FROM v)"
)


@query(_VOTES + " SELECT vec_id, geometric, velocity FROM s", "pts")
def f22_votes(spark, d):
    return E.votes(P.polylines(spark, d)).select("vec_id", "geometric", "velocity")


@query(_VOTES +
    ", walk AS (SELECT fish_id, n, vec_id, CASE WHEN 0.5::DOUBLE * geometric + 0.3::DOUBLE * velocity >= 0 THEN 1 ELSE -1 END AS o "
    "FROM s WHERE n = 1 UNION ALL SELECT s.fish_id, s.n, s.vec_id, CASE WHEN 0.5::DOUBLE * geometric + 0.3::DOUBLE * velocity + "
    "0.4::DOUBLE * walk.o >= 0 THEN 1 ELSE -1 END FROM walk JOIN s ON s.fish_id = walk.fish_id AND s.n = walk.n + 1) SELECT vec_id, "
    "o AS orientation FROM walk", "pts")
def w8_orientation(spark, d):
    """Each frame's orientation by its votes and the one before it: a fold over a fish's frames in order."""
    return E.orientations(E.votes(P.polylines(spark, d)))


ORACLE_SQL["w8_orientation"] = ORACLE_SQL["w8_orientation"].replace("WITH ", "WITH RECURSIVE ", 1)


@query(_VOTES +
    ", o AS (SELECT vec_id, CASE WHEN 0.5::DOUBLE * geometric + 0.3::DOUBLE * velocity >= 0 THEN 1 ELSE -1 END AS o FROM s) SELECT "
    "vec_id, CASE WHEN o = 1 THEN i ELSE 31 - i END AS i, round(x, 6) AS x FROM pts JOIN o USING (vec_id)", "pts")
def f23_flipped(spark, d):
    """Midlines with the head first: reversed where the vote is against their order."""
    score = 0.5 * F.col("geometric") + 0.3 * F.col("velocity")
    sign = E.votes(P.polylines(spark, d)).select(F.col("vec_id").alias("v"), F.when(score >= 0, 1).otherwise(-1).alias("o"))
    rows = P.polylines(spark, d).join(sign, F.col("vec_id") == F.col("v"))
    flipped = F.when(F.col("o") == 1, F.col("points")).otherwise(F.reverse("points"))
    return rows.select("vec_id", F.posexplode(flipped).alias("i", "p")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("p.x", 6).alias("x"))


_CLOSEST = (
    "SELECT fish, part, sqrt(pow(px + s1 * ax - qx - s2 * bx, 2) + pow(py + s1 * ay - qy - s2 * by_, 2) + pow(pz + s1 * az - qz - s2 * bz, 2)) AS dist FROM "
    "(SELECT *, (b * e - c * d) / (a * c - b * b) AS s1, (a * e - b * d) / (a * c - b * b) AS s2 FROM (SELECT *, ax*ax+ay*ay+az*az AS a, ax*bx+ay*by_+az*bz AS b, bx*bx+by_*by_+bz*bz AS c, "
    "ax*(px-qx)+ay*(py-qy)+az*(pz-qz) AS d, bx*(px-qx)+by_*(py-qy)+bz*(pz-qz) AS e FROM (SELECT x.fish, x.part, x.ox AS px, x.oy AS py, x.oz AS pz, y.ox AS qx, y.oy AS qy, y.oz AS qz, "
    "x.dx AS ax, x.dy AS ay, x.dz AS az, y.dx AS bx, y.dy AS by_, y.dz AS bz FROM ends x JOIN ends y ON x.fish = y.fish AND x.part = y.part AND x.ray_id < y.ray_id)))"
)


@query(
    ", ends AS (SELECT ray_id // 4 AS fish, ray_id, 'head' AS part, ox, oy, oz, dx, dy, dz FROM rays UNION ALL SELECT ray_id // 4, ray_id, 'tail', oy, oz, ox, dy, dz, dx FROM rays), "
    f"k AS (SELECT fish, avg(dist) FILTER (part = 'head') AS head, avg(dist) FILTER (part = 'tail') AS tail FROM ({_CLOSEST}) GROUP BY fish) "
    "SELECT fish, round(coalesce(head + tail, 0), 6) AS error, CASE WHEN head IS NULL THEN 0 WHEN head + tail <= tail + head THEN 1 ELSE -1 END AS vote "
    "FROM (SELECT DISTINCT fish FROM ends) LEFT JOIN k USING (fish)", "rays")
def f21_geometric_vote(spark, d):
    """How well the rays of heads and of tails meet, against all midlines turned round; here a ray's tail is the ray with its axes moved on by one."""
    rays = P.rays(spark, d).withColumn("fish", F.expr("ray_id div 4"))
    turned = rays.select("fish", "ray_id", *[F.col(f"{p}{b}").alias(f"{p}{a}") for p in "od" for a, b in zip("xyz", "yzx", strict=True)])
    return E.geometric_votes(rays.drop("camera_id"), turned, "fish").select("fish", r6("error"), "vote")


@query(
    ", c AS (SELECT ray_id, cos(ox) AS c, sin(ox) AS s, oy AS t0, oz AS t1, dx AS t2 FROM rays) SELECT ray_id, round(-(c*t0 + s*t1), "
    "6) AS x, round(-(-s*t0 + c*t1), 6) AS y, round(-t2, 6) AS z FROM c", "rays")
def f24_camera_positions(spark, d):
    """Where a camera stands: minus the transposed rotation times the translation."""
    c, s = F.cos("ox"), F.sin("ox")
    rotation = [[c, -s, F.lit(0.0)], [s, c, F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]
    place = G.camera_position(rotation, G.vec("oy", "oz", "dx"))
    return P.rays(spark, d).select("ray_id", *[F.round(v, 6).alias(n) for n, v in zip("xyz", place, strict=True)])
