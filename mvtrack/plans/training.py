"""Registered queries of label generation: from curves, boxes and tracks to the lines of training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labelling, orientation, sequence, tables
from ..sources import projections as P
from .chain import _BASIS, _CP, _TS
from .queries import ORACLE_SQL, query, r6
from .rebuild import _INVERSE, _PIXEL, _TANK, WATER

MOST_RESIDUAL, PAD, CROP = 5.0, 15.0, (128, 64)
_LEAST = round(0.34 * len(_TS))


def fitted(spark: SparkSession, d: str) -> DataFrame:
    """A curve a vector, with a third of the rig as its cameras, each with a residual; every fifth curve has only what the first six cameras give; four to a frame."""
    numbers = "flatten(transform(sequence(0, 6), j -> array(cast(embedding[3 * j] AS double), cast(embedding[3 * j + 1] AS double), abs(cast(embedding[3 * j + 2] AS double)) + 0.8D)))"
    rows = P.read(spark, d, "embeddings").select(F.expr("vec_id div 4").alias("frame_idx"), F.col("vec_id").alias("fish_id"), F.expr(numbers).alias("control"))
    rig = F.array_sort(F.collect_list(F.struct("c", "camera_id")))
    every = P.cameras(spark, d).agg(rig.alias("rig"))  # one row, an array of the cameras
    own = rows.crossJoin(F.broadcast(every)).withColumn("own", F.expr("filter(rig, r -> (fish_id + r.c) % 3 = 0 AND (fish_id % 5 > 0 OR r.c < 6))"))
    per = F.expr("map_from_entries(transform(own, r -> struct(r.camera_id, (fish_id * 7 + r.c * 3) % 13 * 0.5D)))")
    rows = own.select("frame_idx", "fish_id", "control", F.size("own").cast("long").alias("n_cameras"), per.alias("per_camera"))
    return rows.withColumn("mean_residual", F.expr("aggregate(map_values(per_camera), 0D, (s, v) -> s + v) / n_cameras"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rig = P.cameras(spark, d)
    table = tables.inverse_table(tables.voxel_grid(spark, rig, **_TANK), rig, WATER)
    boxes = P.detections(spark, d).withColumns({"w": F.col("w") * 8, "h": F.col("h") * 8})
    curves = labelling.described(fitted(spark, d))
    tank = {k: _TANK[k] for k in ("diameter", "water_z", "resolution")}
    missed = labelling.gap_views(curves, rig, table, boxes, P.observations(spark, d), tank)
    return labelling.labels(curves, rig, _TS, WATER, missed, PAD, MOST_RESIDUAL)


_IN = "u >= 0 AND u < 1600 AND v >= 0 AND v < 1200"


def _boxed_sql(name: str, points: str, keys: str, pad: float) -> str:
    """Corners (x1, y1 ... x4, y4) of the box along the main axis of the seen points (u, v) of each group."""
    corners = ", ".join(
        f"m{'u' if a == 'x' else 'v'} + {s} * ext * {'cos' if a == 'x' else 'sin'}(t) {'-' if a == 'x' else '+'} {w} * {pad} * {'sin' if a == 'x' else 'cos'}(t) AS {a}{k}"
        for k, s, w in ((1, -1, -1), (2, 1, -1), (3, 1, 1), (4, -1, 1)) for a in "xy")
    return (
        f", {name}_m AS (SELECT {keys}, count(*) AS n_visible, avg(u) AS mu, avg(v) AS mv, 0.5 * atan2(2 * covar_pop(u, v), var_pop(u) - var_pop(v)) AS t FROM {points} WHERE seen GROUP BY ALL HAVING count(*) >= 2), "
        f"{name}_e AS (SELECT {keys}, any_value(n_visible) AS n_visible, any_value(mu) AS mu, any_value(mv) AS mv, any_value(t) AS t, max(abs((u - mu) * cos(t) + (v - mv) * sin(t))) + 2 AS ext "
        f"FROM {points} JOIN {name}_m USING ({keys}) WHERE seen GROUP BY {keys}), {name} AS (SELECT {keys}, n_visible, {corners} FROM {name}_e)"
    )


_STEP = ", ".join(f"{a} - lag({a}) OVER o AS s{a}" for a in "xyz")
_LABELS = (
    _BASIS + _CP + _INVERSE + ", mids AS (SELECT vec_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM cp GROUP BY vec_id), "
    "res AS (SELECT vec_id, camera_id, (vec_id * 7 + c * 3) % 13 * 0.5::DOUBLE AS residual FROM mids, cams WHERE (vec_id + c) % 3 = 0 AND (vec_id % 5 > 0 OR c < 6)), "
    "fit AS (SELECT vec_id, count(*) AS n_cameras, avg(residual) AS mean_residual, var_pop(residual) AS spread FROM res GROUP BY vec_id), "
    f"bend AS (SELECT vec_id, avg(turn / CASE WHEN len > 1e-12 THEN len ELSE 1 END) AS curvature FROM (SELECT vec_id, sqrt(pow(tx - sx, 2) + pow(ty - sy, 2) + pow(tz - sz, 2)) AS turn, "
    "0.5 * (sqrt(sx * sx + sy * sy + sz * sz) + sqrt(tx * tx + ty * ty + tz * tz)) AS len FROM (SELECT *, lead(sx) OVER o AS tx, lead(sy) OVER o AS ty, lead(sz) OVER o AS tz "
    f"FROM (SELECT vec_id, j, {_STEP} FROM cp WINDOW o AS (PARTITION BY vec_id ORDER BY j)) WINDOW o AS (PARTITION BY vec_id ORDER BY j)) WHERE sx IS NOT NULL AND tx IS NOT NULL) GROUP BY vec_id), "
    "gap AS (SELECT vec_id, camera_id FROM (SELECT vec_id, CAST(round((x - (mx - 1.1)) / 0.097::DOUBLE) AS BIGINT) AS ix, CAST(round((y - (my - 1.1)) / 0.097::DOUBLE) AS BIGINT) AS iy, "
    "CAST(round((z - 0.75::DOUBLE) / 0.097::DOUBLE) AS BIGINT) AS iz FROM mids JOIN fit USING (vec_id), mid WHERE n_cameras >= 3) JOIN inv USING (ix, iy, iz) EXCEPT SELECT vec_id, camera_id FROM res), "
    f"gpix AS (SELECT vec_id, vec_id // 4 AS frame_idx, camera_id, u, v FROM {_PIXEL} (SELECT mids.*, cams.*, x - px AS dx, y - py AS dy FROM mids JOIN gap USING (vec_id) JOIN cams USING (camera_id)))))), "
    "hit AS (SELECT DISTINCT vec_id, g.camera_id FROM gpix g JOIN det d ON d.frame_idx = g.frame_idx AND d.camera_id = g.camera_id AND u >= d.x AND u <= d.x + 8 * d.w AND v >= d.y AND v <= d.y + 8 * d.h), "
    "trk AS (SELECT frame_idx, camera_id, count(*) AS n_tracked FROM obs WHERE status = 'detected' GROUP BY ALL), "
    "src AS (SELECT vec_id, camera_id, 'consensus' AS source, NULL AS reason FROM res WHERE residual <= 5 UNION ALL SELECT g.vec_id, g.camera_id, 'gap', "
    "CASE WHEN h.vec_id IS NULL THEN 'no-detection' WHEN n_tracked IS NULL THEN 'no-tracklet' ELSE 'failed-midline' END FROM gpix g LEFT JOIN hit h ON h.vec_id = g.vec_id AND h.camera_id = g.camera_id "
    "LEFT JOIN trk ON trk.frame_idx = g.frame_idx AND trk.camera_id = g.camera_id), "
    f"pts2 AS (SELECT vec_id, camera_id, source, reason, k, u, v, {_IN} AS seen FROM {_PIXEL} (SELECT curve.*, cams.*, source, reason, x - px AS dx, y - py AS dy FROM src JOIN curve USING (vec_id) JOIN cams USING (camera_id))))))"
    + _boxed_sql("box", "pts2", "vec_id, camera_id", PAD)
    + ", lab AS (SELECT vec_id // 4 AS frame_idx, vec_id AS fish_id, camera_id, source, reason, n_visible, n_visible >= " + str(_LEAST) + " AS posed, "
    "printf('0 " + " ".join(["%.6f"] * 8) + "', " + ", ".join(f"round(CAST({a}{i} / {s} AS DECIMAL(18, 9)), 6)::DOUBLE" for i in range(1, 5) for a, s in (("x", 1600), ("y", 1200))) + ") AS obb_line, "
    "0.5 * greatest(0, 1 - mean_residual / 10) + 0.3 * greatest(0, least(1, (n_cameras - 2) / 6)) + 0.2 * greatest(0, 1 - spread / 25) AS confidence, curvature, n_cameras "
    "FROM box JOIN src USING (vec_id, camera_id) JOIN fit USING (vec_id) JOIN bend USING (vec_id))"
)
_VIEWS = ("cams", "det", "obs")


@query(_LABELS + " SELECT frame_idx, fish_id, camera_id, source, reason, n_visible, posed, obb_line, round(confidence, 6) AS confidence, round(curvature, 6) AS curvature, n_cameras FROM lab", *_VIEWS)
def d12_labels(spark, d):
    """Labels of all curves, in the cameras that took part and in those that should have."""
    return _labelled(spark, d).select("frame_idx", "fish_id", "camera_id", "source", "reason", "n_visible", "posed", "obb_line", r6("confidence"), r6("curvature"), "n_cameras")


_IMAGES = _LABELS + (
    ", img AS (SELECT frame_idx, camera_id, printf('%06d_%s', frame_idx, camera_id) AS image, count(*) AS n_labels, coalesce(any_value(n_tracked), 0) AS n_tracked, "
    "coalesce(any_value(n_tracked), 0) = 0 OR count(*) >= any_value(n_tracked) AS complete, string_agg(obb_line, chr(10) ORDER BY fish_id) AS lines, avg(confidence) AS confidence "
    "FROM lab LEFT JOIN trk USING (frame_idx, camera_id) GROUP BY frame_idx, camera_id)"
)


@query(_IMAGES + " SELECT * REPLACE (round(confidence, 6) AS confidence) FROM img", *_VIEWS)
def d12_images(spark, d):
    """The box lines of each image, and whether all that is tracked in it has one."""
    return labelling.images(_labelled(spark, d), P.observations(spark, d)).drop("report").withColumn("confidence", F.round("confidence", 6))


@query(
    _IMAGES + " SELECT count(*) FILTER (complete) AS images, coalesce(sum(n_labels) FILTER (complete), 0) AS labels, round(coalesce(sum(confidence * n_labels) FILTER (complete) / sum(n_labels) FILTER (complete), 0), 6) AS mean_confidence, "
    "count(*) FILTER (NOT complete) AS skipped, (SELECT count(*) FROM lab WHERE posed AND source = 'consensus') AS posed_consensus, (SELECT count(*) FROM lab WHERE posed AND source = 'gap') AS posed_gap FROM img", *_VIEWS)
def d12_summary(spark, d):
    """How many images and labels there are, and how many images lack one."""
    made = sequence.checkpointed(_labelled(spark, d))
    return labelling.summary(made, labelling.images(made, P.observations(spark, d))).withColumn("mean_confidence", F.round("mean_confidence", 6))


def _crops_sql() -> str:
    w, h = CROP
    along = lambda to: f"((p.u - a.x1) * (a.x{to} - a.x1) + (p.v - a.y1) * (a.y{to} - a.y1)) / (pow(a.x{to} - a.x1, 2) + pow(a.y{to} - a.y1, 2))"
    part = lambda c, size: f"round(CAST(greatest(0, least(1, ({c}) / {size}::DOUBLE)) AS DECIMAL(18, 9)), 6)::DOUBLE"
    low, high = ({a: f"{f}({', '.join(f'greatest(0, least({size - 1}, {a}{i}))' for i in range(1, 5))})" for a, size in (("x", w), ("y", h))} for f in ("least", "greatest"))
    head = ", ".join([part(f"({low[a]} + {high[a]}) / 2", size) for a, size in (("x", w), ("y", h))] + [part(f"{high[a]} - {low[a]}", size) for a, size in (("x", w), ("y", h))])
    return (
        ", own AS (SELECT lab.frame_idx, lab.camera_id, lab.source, fish_id, row_number() OVER (PARTITION BY lab.frame_idx, lab.camera_id, lab.source ORDER BY fish_id) - 1 AS crop, x1, y1, x2, y2, x4, y4 "
        "FROM lab JOIN box ON vec_id = fish_id AND box.camera_id = lab.camera_id WHERE posed), "
        f"raw AS (SELECT a.frame_idx, a.camera_id, a.source, a.crop, a.fish_id, b.fish_id AS other, p.k, {along(2)} * {w - 1} AS u, {along(4)} * {h - 1} AS v, p.seen FROM own a "
        "JOIN own b ON a.frame_idx = b.frame_idx AND a.camera_id = b.camera_id AND a.source = b.source JOIN pts2 p ON p.vec_id = b.fish_id AND p.camera_id = b.camera_id), "
        f"put AS (SELECT frame_idx, camera_id, source, crop, fish_id, other, k, greatest(0, least({w - 1}, u)) AS u, greatest(0, least({h - 1}, v)) AS v, seen AND u >= 0 AND u < {w} AND v >= 0 AND v < {h} AS seen FROM raw)"
        + _boxed_sql("small", "put", "frame_idx, camera_id, source, crop, fish_id, other", PAD)
        + f", tri AS (SELECT frame_idx, camera_id, source, crop, fish_id, other, string_agg(CASE WHEN seen THEN printf('%.6f %.6f 2', {part('u', w)}, {part('v', h)}) ELSE '0 0 0' END, ' ' ORDER BY k) AS triples FROM put GROUP BY ALL), "
        f"line AS (SELECT s.frame_idx, s.camera_id, s.source, s.crop, s.fish_id, s.other, printf('0 %.6f %.6f %.6f %.6f ', {head}) || triples AS line FROM small s JOIN tri USING (frame_idx, camera_id, source, crop, fish_id, other) WHERE n_visible >= {_LEAST}) "
        "SELECT frame_idx, camera_id, source, crop, fish_id, printf('%06d_%s_%03d', frame_idx, camera_id, crop) AS image, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY other) AS lines FROM line GROUP BY ALL"
    )


@query(_LABELS + _crops_sql(), *_VIEWS)
def d12_crops(spark, d):
    """A crop around each fish, with the keypoints of all fish that show in it."""
    return labelling.crops(_labelled(spark, d), *CROP, PAD, _LEAST)


# -- orientation ------------------------------------------------------------------------------------

_TURNED = (
    ", det2 AS (SELECT vec_id, any_value(label) AS label, k, 1000 * avg(x) AS u, 1000 * avg(y) AS v, 1000 * (max(x) FILTER (i = 0) - max(x) FILTER (i = 31)) AS hu, "
    "1000 * (max(y) FILTER (i = 0) - max(y) FILTER (i = 31)) AS hv, 1000 * max(x) FILTER (i = 0) AS head, 1000 * max(x) FILTER (i = 31) AS tail FROM pts, (SELECT unnest(range(2)) AS k) "
    "WHERE k = 0 OR vec_id % 9 = 0 GROUP BY vec_id, k), line AS (SELECT * FROM det2 WHERE vec_id % 7 > 0 AND vec_id % 11 > 0), "
    "move AS (SELECT label, vec_id, k, place - lag(place) OVER w AS du, v - lag(v) OVER w AS dv FROM (SELECT *, u + CASE WHEN vec_id % 11 = 0 THEN 12 ELSE 3 END AS place FROM det2) WINDOW w AS (PARTITION BY label, k ORDER BY vec_id)), "
    "gone AS (SELECT vec_id, arg_min(du, k) AS du, arg_min(dv, k) AS dv FROM move WHERE du IS NOT NULL GROUP BY vec_id), "
    "base AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, CASE WHEN cameras > 1 THEN 1 ELSE 0 END + 0.5::DOUBLE * CASE WHEN du IS NULL OR sqrt(du * du + dv * dv) < 2 OR sqrt(hu * hu + hv * hv) < 1e-6 THEN 0 "
    "WHEN hu * du + hv * dv > 0 THEN 1 ELSE -1 END AS votes FROM (SELECT any_value(label) AS label, vec_id, count(*) AS cameras, arg_min(hu, k) AS hu, arg_min(hv, k) AS hv FROM line GROUP BY vec_id) LEFT JOIN gone USING (vec_id)), "
    "walk AS (SELECT label, n, vec_id, CASE WHEN votes >= 0 THEN 1 ELSE -1 END AS o FROM base WHERE n = 1 UNION ALL "
    "SELECT b.label, b.n, b.vec_id, CASE WHEN votes + 0.3::DOUBLE * walk.o >= 0 THEN 1 ELSE -1 END FROM walk JOIN base b ON b.label = walk.label AND b.n = walk.n + 1) "
    "SELECT line.label AS fish_id, vec_id AS frame_idx, 'cam_' || k AS camera_id, o AS orientation, round(CASE WHEN o = 1 THEN head ELSE tail END, 5) AS head FROM line JOIN walk USING (vec_id)"
)


@query(_TURNED, "pts")
def c3_oriented_midlines(spark, d):
    """Midlines of tracked fish with the head first.

    A vector is a frame of its label's fish, seen by one camera and in each ninth
    frame by two; some of a frame's detections have no midline, and some tracks
    are out of reach of theirs.
    """
    lines = P.polylines(spark, d).select("vec_id", F.col("label").alias("fish_id"), F.expr("transform(points, p -> struct(1000 * p.x AS u, 1000 * p.y AS v))").alias("points"))
    mean = {a: F.expr(f"aggregate(points, 0D, (s, p) -> s + p.{a}) / size(points)") for a in "uv"}
    seen = lines.withColumns(mean).withColumn("k", F.explode(F.expr("IF(vec_id % 9 = 0, array(0, 1), array(0))"))).withColumn("camera_id", F.concat(F.lit("cam_"), F.col("k").cast("string")))
    seen = seen.withColumnRenamed("vec_id", "frame_idx")
    other = lambda off, number: seen.select("frame_idx", "camera_id", (F.col("fish_id") + number).alias("det_idx"), (F.col("u") + off).alias("u"), "v", F.lit(None).cast(seen.schema["points"].dataType).alias("points"))
    own = seen.select("frame_idx", "camera_id", F.col("fish_id").alias("det_idx"), "u", "v", "points")
    midlines = own.unionByName(other(20, 1000)).unionByName(other(4, 2000).where("frame_idx % 7 = 0"))
    tracks = seen.select("fish_id", "camera_id", F.col("fish_id").alias("track_id"), "frame_idx", F.expr("u + IF(frame_idx % 11 = 0, 12, 3)").alias("u"), "v")
    out = orientation.oriented(tracks, midlines)
    return out.select("fish_id", "frame_idx", "camera_id", "orientation", F.round(F.col("points")[0]["u"], 5).alias("head"))


ORACLE_SQL["c3_oriented_midlines"] = ORACLE_SQL["c3_oriented_midlines"].replace("WITH ", "WITH RECURSIVE ", 1)
