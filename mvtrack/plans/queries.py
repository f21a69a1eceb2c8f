"""The registered queries of the core library, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import graph, matching, metrics, reconstruction, sequence, store, tracking
from ..sources import projections as P

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Registers a query; ``views`` are the projections that its SQL reads."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = "WITH " + ", ".join(P.SQL[v] for v in views) + ("" if sql.lstrip().startswith(",") else " ") if views else ""
            ORACLE_SQL[f.__name__] = head + sql
        return f

    return add


def r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


# -- filters and projections ----------------------------------------------------------------------


@query("SELECT camera_id, track_id, frame_idx, u, v FROM obs WHERE status = 'detected' AND frame_idx < 400 AND frame_idx % 5 = 0", "obs")
def p1_status_bounds_stride(spark, d):
    return P.observations(spark, d).where("status = 'detected' AND frame_idx < 400 AND frame_idx % 5 = 0").drop("status")


@query("SELECT vec_id, count(*) AS n_kept FROM pts WHERE x >= 0.05 GROUP BY vec_id HAVING count(*) >= 12", "pts")
def p4_confidence_floor(spark, d):
    kept = P.polylines(spark, d).select("vec_id", F.size(F.filter("points", lambda p: p["x"] >= 0.05)).cast("bigint").alias("n_kept"))
    return kept.where("n_kept >= 12")


@query("SELECT vec_id FROM pts GROUP BY vec_id HAVING sum(CAST(x >= 0 AND y >= 0 AS INT)) >= 0.25 * count(*) AND count(*) >= 2", "pts")
def p6_share_in_bounds(spark, d):
    inside = F.size(F.filter("points", lambda p: (p["x"] >= 0) & (p["y"] >= 0)))
    return P.polylines(spark, d).where((inside >= 0.25 * F.size("points")) & (F.size("points") >= 2)).select("vec_id")


@query(
        ", lab AS (SELECT frame_idx, camera_id, count(*) AS n FROM obs WHERE status = 'detected' GROUP BY ALL), trk AS (SELECT "
        "frame_idx, camera_id, count(*) AS n FROM obs GROUP BY ALL) SELECT trk.frame_idx, trk.camera_id FROM trk LEFT JOIN lab USING "
        "(frame_idx, camera_id) WHERE coalesce(lab.n, 0) >= trk.n OR trk.n = 0",
    "obs",
)
def p10_complete_frames(spark, d):
    obs = P.observations(spark, d)
    per = obs.groupBy("frame_idx", "camera_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "detected").alias("lab"))
    return per.where("lab >= n OR n = 0").select("frame_idx", "camera_id")


@query("SELECT ray_id FROM rays WHERE (ox - 0.1) * (ox - 0.1) + oy * oy <= 0.04", "rays")
def p14_cylinder(spark, d):
    return P.rays(spark, d).where("(ox - 0.1) * (ox - 0.1) + oy * oy <= 0.04").select("ray_id")


# -- joins ----------------------------------------------------------------------------------------

_POINTS = ", p AS (SELECT frame_idx % 500 AS frame_idx, 'cam_' || (track_id % 8) AS camera_id, track_id * 1000 + frame_idx AS point_id, u * 4 AS px, v AS py FROM obs)"
_NEAR = (
    ", m AS (SELECT frame_idx, camera_id, point_id, det_idx, sqrt((px - x - w / 2) * (px - x - w / 2) + (py - y - h / 2) * (py - y - "
    "h / 2)) AS dist FROM p JOIN det USING (frame_idx, camera_id))"
)


def _points(spark, d):
    obs = P.observations(spark, d)
    return obs.select((F.col("frame_idx") % 500).alias("frame_idx"), F.concat(F.lit("cam_"), (F.col("track_id") % 8).cast("string")).alias("camera_id"), (F.col("track_id") * 1000 + F.col("frame_idx")).alias("point_id"), (F.col("u") * 4).alias("px"), F.col("v").alias("py"))


def _nearest_sql(test: str, tie: str) -> str:
    return _POINTS + _NEAR + f" SELECT frame_idx, camera_id, point_id, det_idx, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY frame_idx, camera_id, point_id ORDER BY dist, {tie}) AS k FROM m WHERE dist {test}) WHERE k = 1"


@query(_nearest_sql("< 200", "det_idx"), "obs", "det")
def j4_nearest_detection(spark, d):
    return matching.nearest(_points(spark, d), P.detections(spark, d), 200).withColumn("dist", F.round("dist", 6))


@query(_nearest_sql("<= 120", "det_idx DESC"), "obs", "det")
def j6_nearest_last_wins(spark, d):
    return matching.nearest(_points(spark, d), P.detections(spark, d), 120, inclusive=True, last_wins=True).withColumn("dist", F.round("dist", 6))


@query(_POINTS + _NEAR +
    " SELECT DISTINCT det.frame_idx, det.camera_id, det.det_idx FROM det SEMI JOIN (SELECT frame_idx, camera_id, arg_min(det_idx, "
    "struct_pack(a := dist, b := det_idx)) AS det_idx FROM m WHERE dist < 200 GROUP BY frame_idx, camera_id, point_id) USING "
    "(frame_idx, camera_id, det_idx)", "obs", "det")
def p3_referenced_detections(spark, d):
    """A match has the whole key of its box, so the boxes are read once."""
    return matching.nearest(_points(spark, d), P.detections(spark, d), 200).select("frame_idx", "camera_id", "det_idx").distinct()


@query(
    "SELECT DISTINCT a.camera_id, a.track_id AS track_a, b.track_id AS track_b FROM obs a JOIN obs b ON a.camera_id = b.camera_id "
    "AND a.frame_idx = b.frame_idx AND a.track_id < b.track_id WHERE a.status = 'detected' AND b.status = 'detected'", "obs")
def j3_must_not_link(spark, d):
    return matching.must_not_link(P.observations(spark, d))


_SCORE = """, adj AS (SELECT a.camera_id AS ca, b.camera_id AS cb FROM (SELECT DISTINCT camera_id, frame_idx FROM obs) a JOIN (SELECT DISTINCT camera_id, frame_idx FROM obs) b ON a.frame_idx = b.frame_idx AND a.camera_id < b.camera_id GROUP BY ALL HAVING count(*) >= 20), both_ AS (SELECT a.camera_id AS camera_a, a.track_id AS track_a, b.camera_id AS camera_b, b.track_id AS track_b, a.frame_idx, sqrt((a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v)) AS dist FROM obs a JOIN obs b ON a.frame_idx = b.frame_idx AND a.camera_id < b.camera_id SEMI JOIN adj ON a.camera_id = ca AND b.camera_id = cb), near_ AS (SELECT *, CASE WHEN dist < 100 THEN 1 - dist / 100 ELSE 0 END AS near, row_number() OVER (PARTITION BY camera_a, track_a, camera_b, track_b ORDER BY frame_idx) AS rk FROM both_), score AS (SELECT camera_a, track_a, camera_b, track_b, count(*) AS n_shared, CASE WHEN count(*) < 3 OR (count(*) >= 3 AND sum(CASE WHEN rk <= 3 THEN near ELSE 0 END) = 0) THEN 0 ELSE sum(near) / count(*) * least(count(*), 20) / 20 END AS score FROM near_ GROUP BY ALL)"""


def _tracks(spark, d):
    """Observations, cut once, and the cameras to compare."""
    obs = sequence.checkpointed(P.observations(spark, d))
    return obs, matching.adjacency(obs, 20)


def _scores(spark, d, least):
    return matching.pair_scores(*_tracks(spark, d), 100.0, 3, 20, 3, least_score=least)


@query(_SCORE + " SELECT camera_a, track_a, camera_b, track_b, n_shared, round(score, 6) AS score FROM score WHERE score > 0", "obs")
def a1_pair_affinity(spark, d):
    return _scores(spark, d, 0.0).withColumn("score", F.round("score", 6))


@query(
    "SELECT a.camera_id AS camera_a, b.camera_id AS camera_b, count(*) AS shared FROM (SELECT DISTINCT camera_id, frame_idx FROM "
    "obs) a JOIN (SELECT DISTINCT camera_id, frame_idx FROM obs) b ON a.frame_idx = b.frame_idx AND a.camera_id < b.camera_id GROUP "
    "BY ALL HAVING count(*) >= 20", "obs")
def j13_camera_overlap(spark, d):
    return matching.overlap_graph(P.observations(spark, d).select(F.col("frame_idx").alias("voxel"), "camera_id").distinct(), 20)


@query(
    ", vis AS (SELECT DISTINCT frame_idx AS id, camera_id FROM det), con AS (SELECT DISTINCT frame_idx AS id, camera_id FROM det "
    "WHERE confidence > 0.97) SELECT vis.id, vis.camera_id FROM vis SEMI JOIN (SELECT id FROM con GROUP BY id HAVING count(*) >= 3) "
    "e USING (id) ANTI JOIN con USING (id, camera_id)", "det")
def j10_gap_cameras(spark, d):
    boxes = P.detections(spark, d)
    visible = boxes.select(F.col("frame_idx").alias("id"), "camera_id").distinct()
    contributing = boxes.where("confidence > 0.97").select(F.col("frame_idx").alias("id"), "camera_id").distinct()
    return matching.gaps(visible, contributing, 3)


@query(
    ", k AS (SELECT ray_id, camera_id, CAST(round_even((ox + 1) / 0.05, 0) AS BIGINT) AS ix, CAST(round_even((oy + 1) / 0.05, 0) AS "
    "BIGINT) AS iy FROM rays) SELECT a.ray_id, count(*) AS n FROM k a JOIN k b USING (ix, iy) GROUP BY a.ray_id", "rays")
def j12_voxel_lookup(spark, d):
    k = P.rays(spark, d).select("ray_id", matching.voxel_key(F.col("ox"), -1.0, 0.05).alias("ix"), matching.voxel_key(F.col("oy"), -1.0, 0.05).alias("iy"))
    sizes = k.groupBy("ix", "iy").agg(F.count("*").alias("n"))
    return k.join(sizes, ["ix", "iy"]).select("ray_id", "n")


@query(
    "SELECT o.camera_id, o.track_id, o.frame_idx, coalesce(g.fish_id, -1) AS fish_id FROM obs o LEFT JOIN (SELECT DISTINCT "
    "camera_id, track_id, track_id // 2 AS fish_id FROM obs WHERE track_id % 3 > 0) g USING (camera_id, track_id)", "obs")
def j14_fish_of_tracks(spark, d):
    obs = P.observations(spark, d)
    groups = obs.where("track_id % 3 > 0").select("camera_id", "track_id", F.expr("track_id div 2").alias("fish_id")).distinct()
    return obs.join(groups, ["camera_id", "track_id"], "left").select("camera_id", "track_id", "frame_idx", F.coalesce("fish_id", F.lit(-1)).alias("fish_id"))


# -- aggregations ---------------------------------------------------------------------------------


@query(
    "SELECT count(*) AS n_tracks, median(n) AS median_length, round(avg(n), 6) AS mean_length, min(n) AS min_length, max(n) AS "
    "max_length, round(sum(c)::DOUBLE / sum(n), 6) AS coast_fraction, round(1 - sum(c)::DOUBLE / sum(n), 6) AS coverage FROM (SELECT "
    "count(*) AS n, count(*) FILTER (status = 'coasted') AS c FROM obs GROUP BY camera_id, track_id)", "obs")
def a4_tracking_metrics(spark, d):
    return metrics.tracking_metrics(P.observations(spark, d))


_JITTER = (
    ", n AS (SELECT f.frame_idx, c.camera_id, coalesce(k, 0) AS n FROM (SELECT DISTINCT frame_idx FROM det) f CROSS JOIN (SELECT "
    "DISTINCT camera_id FROM det) c LEFT JOIN (SELECT frame_idx, camera_id, count(*) AS k FROM det GROUP BY ALL) USING (frame_idx, "
    "camera_id)), j AS (SELECT camera_id, avg(s) AS jitter, CAST(sum(n) AS BIGINT) AS n FROM (SELECT camera_id, n, abs(n - lag(n) "
    "OVER (PARTITION BY camera_id ORDER BY frame_idx)) AS s FROM n) GROUP BY camera_id)"
)


@query(_JITTER +
    " SELECT (SELECT count(*) FROM det) AS total, (SELECT round(avg(confidence), 5) FROM det) AS mean_confidence, (SELECT "
    "round(stddev_pop(confidence), 5) FROM det) AS std_confidence, round(avg(jitter), 6) AS mean_jitter FROM j", "det")
def a2_detection_metrics(spark, d):
    return metrics.detection_metrics(P.detections(spark, d))


@query(_JITTER + " SELECT camera_id, round(jitter, 6) AS jitter, n FROM j", "det")
def a3_jitter(spark, d):
    return metrics.jitter(metrics.frame_counts(P.detections(spark, d))).select("camera_id", r6("jitter"), "n")


_SETS = ", s AS (SELECT DISTINCT frame_idx, track_id // 10 AS fish_id, camera_id FROM obs WHERE status = 'detected')"


def _sets(spark, d):
    return P.observations(spark, d).where("status = 'detected'").select("frame_idx", F.expr("track_id div 10").alias("fish_id"), "camera_id")


@query(_SETS +
    ", p AS (SELECT frame_idx, fish_id, count(*) AS c FROM s GROUP BY ALL) SELECT count(*) AS observations, round(count(*) FILTER (c "
    "= 1)::DOUBLE / greatest(count(*), 1), 6) AS singleton_rate, round(count(*) FILTER (c > 1)::DOUBLE / (SELECT count(DISTINCT "
    "frame_idx) FROM obs) / 9, 6) AS yield FROM p", "obs")
def a5_association_metrics(spark, d):
    return metrics.association_metrics(_sets(spark, d), P.observations(spark, d), 9)


@query(_SETS + " SELECT c AS cameras, count(*) AS n FROM (SELECT count(*) AS c FROM s GROUP BY frame_idx, fish_id) GROUP BY c", "obs")
def a5_camera_distribution(spark, d):
    return metrics.camera_distribution(_sets(spark, d))


@query(
    ", f AS (SELECT frame_idx % 20 AS fish_id, avg(w) AS mean, max(w) AS max, count(*) AS n FROM det GROUP BY 1) SELECT 'camera' AS "
    "level, camera_id AS name, round(avg(w), 6) AS mean, max(w) AS max, count(*) AS n FROM det GROUP BY camera_id UNION ALL SELECT "
    "'fish', CAST(fish_id AS VARCHAR), round(mean, 6), max, n FROM f UNION ALL SELECT 'overall', NULL, round(avg(mean), 6), "
    "max(max), CAST(sum(n) AS BIGINT) FROM f", "det")
def a7_residual_tiers(spark, d):
    return metrics.residual_tiers(P.detections(spark, d).select((F.col("frame_idx") % 20).alias("fish_id"), "camera_id", F.col("w").alias("residual")))


@query(
    ", c AS (SELECT track_id AS fish_id, frame_idx, avg(u) AS x, avg(v) AS y FROM obs GROUP BY ALL), s AS (SELECT fish_id, sqrt((x - "
    "lag(x) OVER q) * (x - lag(x) OVER q) + (y - lag(y) OVER q) * (y - lag(y) OVER q)) AS st FROM c WINDOW q AS (PARTITION BY "
    "fish_id ORDER BY frame_idx)) SELECT fish_id, round(coalesce(avg(st), 0), 6) AS mean_step FROM s GROUP BY fish_id", "obs")
def a6_centroid_steps(spark, d):
    return metrics.centroid_steps(P.observations(spark, d).select(F.col("track_id").alias("fish_id"), "frame_idx", F.col("u").alias("x"), F.col("v").alias("y")))


@query(
    ", v AS (SELECT CAST(run AS VARCHAR) AS name, avg(metric) AS value FROM runs GROUP BY run) SELECT name, round(value, 6) AS value "
    "FROM v, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM v) WHERE value > m + 2 * s", "runs")
def a25_outliers(spark, d):
    values = P.runs(spark, d).groupBy(F.col("run").cast("string").alias("name")).agg(F.avg("metric").alias("value"))
    return metrics.outliers(values).select("name", r6("value"))


@query(
    ", per AS (SELECT frame_idx, count(DISTINCT camera_id) AS k FROM det GROUP BY frame_idx), b AS (SELECT k, count(*) AS n FROM per "
    "GROUP BY k) SELECT k, round(100.0::DOUBLE * sum(n) OVER (ORDER BY k DESC)::DOUBLE / (SELECT sum(n) FROM b)::DOUBLE, 6) AS pct "
    "FROM b", "det")
def a30_coverage(spark, d):
    return metrics.coverage(P.detections(spark, d).select(F.col("frame_idx").alias("voxel"), "camera_id"))


@query(
        ", q AS (SELECT camera_id, ox, oy, oz, dx / sqrt(dx*dx+dy*dy+dz*dz) AS a, dy / sqrt(dx*dx+dy*dy+dz*dz) AS b, dz / "
        "sqrt(dx*dx+dy*dy+dz*dz) AS c FROM rays), m AS (SELECT camera_id, sum(1-a*a) AS m00, sum(-a*b) AS m01, sum(-a*c) AS m02, "
        "sum(1-b*b) AS m11, sum(-b*c) AS m12, sum(1-c*c) AS m22, sum((1-a*a)*ox - a*b*oy - a*c*oz) AS b0, sum(-a*b*ox + (1-b*b)*oy - "
        "b*c*oz) AS b1, sum(-a*c*ox - b*c*oy + (1-c*c)*oz) AS b2 FROM q GROUP BY camera_id), e AS (SELECT *, m00*(m11*m22-m12*m12) - "
        "m01*(m01*m22-m12*m02) + m02*(m01*m12-m11*m02) AS det FROM m) SELECT camera_id, round((b0*(m11*m22-m12*m12) - "
        "m01*(b1*m22-m12*b2) + m02*(b1*m12-m11*b2)) / det, 6) AS x, round((m00*(b1*m22-m12*b2) - b0*(m01*m22-m12*m02) + "
        "m02*(m01*b2-b1*m02)) / det, 6) AS y, round((m00*(m11*b2-b1*m12) - m01*(m01*b2-b1*m02) + b0*(m01*m12-m11*m02)) / det, 6) AS "
        "z FROM e",
    "rays",
)
def a18_triangulate(spark, d):
    sums = P.rays(spark, d).groupBy("camera_id").agg(*G.triangulation_sums(G.vec("ox", "oy", "oz"), G.vec("dx", "dy", "dz"), F.lit(1.0)))
    x, y, z = G.triangulated()
    return sums.select("camera_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))


@query(
    ", two AS (SELECT run, epoch, CAST(run % 3 AS VARCHAR) AS stage, unnest(['price', 'share', 'late']) AS metric, unnest([metric, metric / 1000, CASE WHEN epoch = 1 THEN metric END]) AS value FROM runs WHERE epoch <= 2), "
    "t(stage, metric, tolerance) AS (VALUES ('0', 'price', 100000.0::DOUBLE), ('1', 'price', 50000.0), ('1', 'share', 20.0), ('2', 'share', 0.0), ('2', 'late', 0.0)) "
    "SELECT a.run || '/' || a.stage AS stage, metric, a.value AS was, b.value AS \"is\", tolerance, abs(b.value - a.value) AS delta FROM two a JOIN two b USING (run, stage, metric) JOIN t USING (stage, metric) "
    "WHERE a.epoch = 1 AND b.epoch = 2 AND abs(b.value - a.value) > tolerance", "runs")
def v5_regression_gate(spark, d):
    """Metrics of each run's second epoch against its first, each kind of run with tolerances of its own."""
    cells = F.expr("inline(array(struct('price' AS metric, metric AS value), struct('share' AS metric, metric / 1000 AS value), struct('late' AS metric, IF(epoch = 1, metric, NULL) AS value)))")
    rows = P.runs(spark, d).where("epoch <= 2").select("run", "epoch", cells)
    named = rows.withColumn("stage", F.expr("concat(cast(run AS string), '/', cast(run % 3 AS string))"))
    kinds = "('0', 'price', 100000D), ('1', 'price', 50000D), ('1', 'share', 20D), ('2', 'share', 0D), ('2', 'late', 0D)"
    limits = spark.sql(f"SELECT * FROM VALUES {kinds} AS t(kind, metric, tolerance)")
    stages = named.select("stage", F.substring_index("stage", "/", -1).alias("kind")).distinct()
    return metrics.regressions(named.where("epoch = 1"), named.where("epoch = 2"), stages.join(F.broadcast(limits), "kind").drop("kind"))  # five rows


@query(
    ", q AS (SELECT a.ray_id AS ray_a, b.ray_id AS ray_b, a.ox-b.ox AS wx, a.oy-b.oy AS wy, a.oz-b.oz AS wz, a.dx AS ax, a.dy AS ay, "
    "a.dz AS az, b.dx AS bx, b.dy AS by_, b.dz AS bz FROM rays a JOIN rays b ON a.ray_id // 8 = b.ray_id // 8 AND a.camera_id < "
    "b.camera_id), t AS (SELECT *, ax*ax+ay*ay+az*az AS a, ax*bx+ay*by_+az*bz AS b, bx*bx+by_*by_+bz*bz AS c, ax*wx+ay*wy+az*wz AS "
    "d, bx*wx+by_*wy+bz*wz AS e FROM q), p AS (SELECT *, (b*e-c*d)/(a*c-b*b) AS s1, (a*e-b*d)/(a*c-b*b) AS s2 FROM t) SELECT ray_a, "
    "ray_b, round(sqrt((wx+s1*ax-s2*bx)*(wx+s1*ax-s2*bx)+(wy+s1*ay-s2*by_)*(wy+s1*ay-s2*by_)+(wz+s1*az-s2*bz)*(wz+s1*az-s2*bz)), 6) "
    "AS dist FROM p", "rays")
def f1_closest_approach(spark, d):
    rays = P.rays(spark, d).withColumn("fish", F.expr("ray_id div 8"))
    a = rays.select("fish", *[F.col(c).alias(f"{c}_a") for c in ("ray_id", "camera_id", "ox", "oy", "oz", "dx", "dy", "dz")])
    b = rays.select("fish", *[F.col(c).alias(f"{c}_b") for c in ("ray_id", "camera_id", "ox", "oy", "oz", "dx", "dy", "dz")])
    dist, _ = G.closest_approach(*[G.vec(*[f"{n}{x}_{s}" for x in "xyz"]) for s in "ab" for n in "od"])
    return a.join(b, "fish").where("camera_id_a < camera_id_b").select(F.col("ray_id_a").alias("ray_a"), F.col("ray_id_b").alias("ray_b"), F.round(dist, 6).alias("dist"))


@query("SELECT ray_id, round(sqrt(greatest(0, ox*ox+oy*oy+oz*oz - (ox*dx+oy*dy+oz*dz)*(ox*dx+oy*dy+oz*dz)/(dx*dx+dy*dy+dz*dz))), 5) AS dist FROM rays", "rays")
def f3_point_line_distance(spark, d):
    zero = (F.lit(0.0),) * 3
    return P.rays(spark, d).select("ray_id", F.round(G.point_line_distance(zero, G.vec("ox", "oy", "oz"), G.vec("dx", "dy", "dz")), 5).alias("dist"))


_CAM = {"fx": 1400.0, "cx": 800.0, "cy": 600.0, "water_z": 0.75}


@query(
    ", q AS (SELECT frame_idx, camera_id, det_idx, (x - 800) / 1400.0::DOUBLE AS px, (y - 600) / 1400.0::DOUBLE AS py FROM det), n "
    "AS (SELECT *, sqrt(px*px+py*py+1) AS l, 1.0::DOUBLE / 1.333::DOUBLE AS k FROM q), e AS (SELECT *, k*px/l AS bx, k*py/l AS by_, "
    "sqrt(greatest(0, 1 - k*k*(1 - 1/(l*l)))) AS bz FROM n) SELECT frame_idx, camera_id, det_idx, round(0.75*px, 6) AS ox, "
    "round(0.75*py, 6) AS oy, round(bx / sqrt(bx*bx+by_*by_+bz*bz), 6) AS dx, round(by_ / sqrt(bx*bx+by_*by_+bz*bz), 6) AS dy, "
    "round(bz / sqrt(bx*bx+by_*by_+bz*bz), 6) AS dz FROM e", "det")
def f4_cast_ray(spark, d):
    o, b = G.refract((F.col("x"), F.col("y")), 1400.0, 800.0, 600.0, (F.lit(0.0),) * 3, 0.75)
    return P.detections(spark, d).select("frame_idx", "camera_id", "det_idx", *[F.round(c, 6).alias(n) for c, n in zip((o[0], o[1], *b), ("ox", "oy", "dx", "dy", "dz"), strict=True)])


@query(
    ", q AS (SELECT vec_id, i, x - lag(x) OVER w AS sx, y - lag(y) OVER w AS sy FROM pts WINDOW w AS (PARTITION BY vec_id ORDER BY i)), "
    "r AS (SELECT *, lead(sx) OVER w AS tx, lead(sy) OVER w AS ty FROM q WINDOW w AS (PARTITION BY vec_id ORDER BY i)), "
    "k AS (SELECT vec_id, sqrt(pow(tx - sx, 2) + pow(ty - sy, 2)) AS turn, 0.5 * (sqrt(sx * sx + sy * sy) + sqrt(tx * tx + ty * ty)) AS step FROM r WHERE sx IS NOT NULL AND tx IS NOT NULL) "
    "SELECT vec_id, round(avg(turn / CASE WHEN step > 1e-12 THEN step ELSE 1 END), 6) AS curvature FROM k GROUP BY vec_id", "pts")
def w10_curvature(spark, d):
    return P.polylines(spark, d).select("vec_id", F.round(G.curvature("points"), 6).alias("curvature"))


@query(
    ", c AS (SELECT vec_id, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM pts GROUP BY vec_id) SELECT vec_id, "
    "round(0.5 * atan2(2 * b, a - c), 6) AS angle FROM c", "pts")
def f14_principal_angle(spark, d):
    rows = P.polylines(spark, d).select("vec_id", F.inline("points"))
    c = rows.groupBy("vec_id").agg(F.var_pop("x").alias("a"), F.covar_pop("x", "y").alias("b"), F.var_pop("y").alias("c"))
    return c.select("vec_id", F.round(G.principal_angle(F.col("a"), F.col("b"), F.col("c")), 6).alias("angle"))


@query(
    "SELECT frame_idx, camera_id, det_idx, round(greatest(0, least(255, 0.2 * x + 0.1 * y - 5)), 6) AS cx, round(greatest(0, "
    "least(127, 0.1 * y - 0.05 * x + 3)), 6) AS cy, round(x, 6) AS bx FROM det", "det")
def f15_affine_crop(spark, d):
    m = (0.2, 0.1, -5.0, -0.05, 0.1, 3.0)
    x, y = G.affine(F.col("x"), F.col("y"), m)
    back = G.inverse_affine(x, y, m)[0]
    return P.detections(spark, d).select("frame_idx", "camera_id", "det_idx", F.round(G.clip(x, 0.0, 255.0), 6).alias("cx"), F.round(G.clip(y, 0.0, 127.0), 6).alias("cy"), F.round(back, 6).alias("bx"))


@query(
    "SELECT frame_idx, camera_id, det_idx, round(0.5 * greatest(0, 1 - w / 10) + 0.3 * greatest(0, least(1, (h - 2) / 6)) + 0.2 * "
    "greatest(0, 1 - w * h / 25), 6) AS score FROM det", "det")
def a26_confidence_score(spark, d):
    return P.detections(spark, d).select("frame_idx", "camera_id", "det_idx", F.round(G.confidence_score(F.col("w"), F.col("h"), F.col("w") * F.col("h")), 6).alias("score"))


# -- sequences ------------------------------------------------------------------------------------


@query(
    ", n AS (SELECT camera_id, track_id, frame_idx, u, v, lead(frame_idx) OVER w AS f2, lead(u) OVER w AS u2, lead(v) OVER w AS v2 "
    "FROM obs WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_idx)) SELECT camera_id, track_id, frame_idx, round(u, 6) "
    "AS u, round(v, 6) AS v, false AS interpolated FROM obs UNION ALL SELECT camera_id, track_id, frame_idx + k, round(u + (u2 - u) "
    "* k::DOUBLE / (f2 - frame_idx), 6), round(v + (v2 - v) * k::DOUBLE / (f2 - frame_idx), 6), true FROM n, (SELECT unnest(range(1, "
    "6)) AS k) WHERE f2 - frame_idx - 1 BETWEEN 1 AND 5 AND k < f2 - frame_idx", "obs")
def w3_fill_gaps(spark, d):
    return sequence.fill_gaps(P.observations(spark, d), sequence.TRACK, ["u", "v"]).withColumn("u", F.round("u", 6)).withColumn("v", F.round("v", 6))


@query(
    "SELECT camera_id, track_id, frame_idx, round(u - pu, 6) AS du, round(v - pv, 6) AS dv, round(sqrt((u - pu) * (u - pu) + (v - "
    "pv) * (v - pv)), 6) AS speed FROM (SELECT *, lag(u) OVER w AS pu, lag(v) OVER w AS pv FROM obs WINDOW w AS (PARTITION BY "
    "camera_id, track_id ORDER BY frame_idx)) WHERE pu IS NOT NULL", "obs")
def w7_velocity(spark, d):
    return sequence.velocities(P.observations(spark, d))


@query(
    "SELECT camera_id, track_id, frame_idx, count(*) OVER w AS length, round(sum(u) OVER w, 6) AS sum_u FROM obs WINDOW w AS "
    "(PARTITION BY camera_id, track_id ORDER BY frame_idx ROWS BETWEEN 30 PRECEDING AND CURRENT ROW)", "obs")
def w9_trails(spark, d):
    rows = sequence.trails(P.observations(spark, d))
    return rows.select("camera_id", "track_id", "frame_idx", F.size("trail").cast("bigint").alias("length"), F.round(F.aggregate("trail", F.lit(0.0), lambda s, p: s + p["u"]), 6).alias("sum_u"))


@query(
    ", s AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER w > 1 THEN 1 ELSE 0 END AS b FROM obs WINDOW w AS (PARTITION BY "
    "camera_id, track_id ORDER BY frame_idx)), i AS (SELECT *, sum(b) OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) AS "
    "island FROM s) SELECT camera_id, track_id, CAST(island AS BIGINT) AS island, min(frame_idx) AS first, max(frame_idx) AS last, "
    "count(*) AS n FROM i GROUP BY ALL", "obs")
def w1_islands(spark, d):
    return sequence.islands(P.observations(spark, d), sequence.TRACK).groupBy(*sequence.TRACK, "island").agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"), F.count("*").alias("n"))


_ISLANDS = (
    ", s AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER w > 1 THEN 1 ELSE 0 END AS b FROM obs WINDOW w AS (PARTITION BY "
    "camera_id, track_id ORDER BY frame_idx)), i AS (SELECT *, sum(b) OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) AS "
    "island FROM s), p AS (SELECT camera_id, track_id, frame_idx, island, u, row_number() OVER (PARTITION BY camera_id, track_id, "
    "island ORDER BY frame_idx) - 1 AS pos, count(*) OVER (PARTITION BY camera_id, track_id, island) AS n FROM i), k AS (SELECT k, "
    "exp(-0.5 * (k / 3.0::DOUBLE) * (k / 3.0::DOUBLE)) AS g FROM (SELECT unnest(range(-12, 13)) AS k)), m AS (SELECT p.*, g / "
    "(SELECT sum(g) FROM k) AS w, ((pos + k) % (2 * n) + 2 * n) % (2 * n) AS spot FROM p, k)"
)


@query(_ISLANDS +
    " SELECT m.camera_id, m.track_id, m.frame_idx, round(sum(w * q.u), 6) AS smoothed FROM m JOIN p q ON q.camera_id = m.camera_id "
    "AND q.track_id = m.track_id AND q.island = m.island AND q.pos = CASE WHEN spot < m.n THEN spot ELSE 2 * m.n - 1 - spot END "
    "GROUP BY ALL", "obs")
def w1_smooth(spark, d):
    return sequence.smooth(P.observations(spark, d), sequence.TRACK, "u").select(*sequence.TRACK, "frame_idx", r6("smoothed"))


@query(
    ", r AS (SELECT track_id // 10 AS fish_id, camera_id, track_id, frame_idx, u, v, CAST(20 + event % 7 AS DOUBLE) AS w, CAST(10 + event % 5 AS DOUBLE) AS h, status "
    "FROM (SELECT *, CAST(v AS BIGINT) AS event FROM obs)), "
    "s AS (SELECT *, row_number() OVER (PARTITION BY fish_id, camera_id ORDER BY b, track_id) AS k FROM (SELECT fish_id, camera_id, track_id, min(frame_idx) AS b, "
    "min(frame_idx) FILTER (status = 'detected') AS f, max(frame_idx) FILTER (status = 'detected') AS l FROM r GROUP BY ALL)), "
    "d AS (SELECT fish_id, camera_id, track_id, frame_idx, k FROM r JOIN s USING (fish_id, camera_id, track_id) WHERE status = 'detected'), "
    "c AS (SELECT y.fish_id, y.camera_id, y.k, max(x.k) AS clash FROM d x JOIN d y ON x.fish_id = y.fish_id AND x.camera_id = y.camera_id AND x.frame_idx = y.frame_idx AND x.k < y.k GROUP BY ALL), "
    "t AS (SELECT s.*, coalesce(clash, 0) AS clash FROM s LEFT JOIN c USING (fish_id, camera_id, k)), "
    "walk AS (SELECT fish_id, camera_id, track_id, k, k AS start, f, l, l AS e FROM t WHERE k = 1 UNION ALL SELECT fish_id, camera_id, track_id, k, CASE WHEN j THEN start ELSE k END, f, l, "
    "CASE WHEN j THEN greatest(e, l) ELSE l END FROM (SELECT t.*, walk.start, walk.e, coalesce(t.clash < walk.start AND t.f - walk.e - 1 <= 30, FALSE) AS j "
    "FROM walk JOIN t ON t.fish_id = walk.fish_id AND t.camera_id = walk.camera_id AND t.k = walk.k + 1)), "
    "g AS (SELECT *, count(*) OVER q AS members, row_number() OVER (PARTITION BY fish_id, camera_id, start ORDER BY k) - 1 AS place, first_value(track_id) OVER (PARTITION BY fish_id, camera_id, start ORDER BY k) AS run "
    "FROM walk WINDOW q AS (PARTITION BY fish_id, camera_id, start)), "
    "m AS (SELECT g.fish_id, g.camera_id, run, place, members, frame_idx, u, v, w, h, status FROM r JOIN g USING (fish_id, camera_id, track_id) WHERE members = 1 OR status = 'detected'), "
    "x AS (SELECT fish_id, camera_id, run, arg_max(struct_pack(u, v, w, h), frame_idx) AS a FROM m WHERE members > 1 AND place = members - 2 GROUP BY ALL), "
    "y AS (SELECT fish_id, camera_id, run, max(place) AS place, arg_min(struct_pack(u, v, w, h), frame_idx) AS b, min(frame_idx) AS f1 FROM m WHERE members > 1 AND place = members - 1 GROUP BY ALL), "
    "z AS (SELECT fish_id, camera_id, run, max(l) AS f0 FROM g WHERE place < members - 1 GROUP BY ALL), "
    "n AS (SELECT *, (fr - f0)::DOUBLE / (f1 - f0) AS q FROM (SELECT *, unnest(range(f0 + 1, f1)) AS fr FROM x JOIN y USING (fish_id, camera_id, run) JOIN z USING (fish_id, camera_id, run))), "
    "o AS (SELECT fish_id, camera_id, run, place, 1 AS late, frame_idx, u, v, w, h, status FROM m UNION ALL "
    "SELECT fish_id, camera_id, run, place, 0, fr, a.u + q * (b.u - a.u), a.v + q * (b.v - a.v), a.w + q * (b.w - a.w), a.h + q * (b.h - a.h), 'interpolated' FROM n) "
    "SELECT fish_id, camera_id, run AS track_id, frame_idx, round(u, 6) AS u, round(v, 6) AS v, round(w, 6) AS w, round(h, 6) AS h, status, "
    "row_number() OVER (PARTITION BY fish_id, camera_id, run ORDER BY place, late, frame_idx) - 1 AS pos FROM o", "obs")
def w4_merge_fragments(spark, d):
    obs = P.observations(spark, d)
    boxed = obs.withColumns({"w": 20.0 + F.col("v").cast("bigint") % 7, "h": 10.0 + F.col("v").cast("bigint") % 5})
    groups = obs.select(F.expr("track_id div 10").alias("fish_id"), *sequence.TRACK).distinct()
    return sequence.merge_fragments(boxed, groups).withColumns({c: F.round(c, 6) for c in "uvwh"})


ORACLE_SQL["w4_merge_fragments"] = ORACLE_SQL["w4_merge_fragments"].replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    ", f AS (SELECT frame_idx, row_number() OVER (ORDER BY frame_idx) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT "
    "frame_idx FROM obs)) SELECT frame_idx FROM f WHERE k IN (SELECT CAST(floor(i * (n - 1) / 14.0::DOUBLE) AS BIGINT) FROM (SELECT "
    "unnest(range(15)) AS i), (SELECT max(n) AS n FROM f))", "obs")
def t1_sampled_frames(spark, d):
    return sequence.sampled_frames(P.observations(spark, d), 15)


@query(
    "SELECT frame_idx, fish_id, slot FROM (SELECT frame_idx, track_id AS fish_id, row_number() OVER (PARTITION BY frame_idx ORDER BY "
    "track_id) - 1 AS slot FROM obs) WHERE slot < 3", "obs")
def t4_slots(spark, d):
    return sequence.slots(P.observations(spark, d).select("frame_idx", F.col("track_id").alias("fish_id")), 3)


@query(
    ", h AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || sample_id), sample_id) AS rk, count(*) OVER "
    "(PARTITION BY source) AS n FROM samples) SELECT sample_id, source, CASE WHEN rk <= greatest(1, CAST(round_even(n * 0.2::DOUBLE, "
    "0) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM h", "samples")
def t6_stratified_split(spark, d):
    return sequence.stratified_split(P.samples(spark, d), "source", "sample_id", 0.2, 42).select("sample_id", "source", "split")


@query(
    "SELECT run, arg_max(epoch, struct_pack(a := metric, b := -epoch)) AS best_epoch, max(metric) AS best, round(sum(metric), 2) AS "
    "total FROM runs GROUP BY run", "runs")
def s21_best_epoch(spark, d):
    return P.runs(spark, d).groupBy("run").agg(F.max_by("epoch", F.struct("metric", -F.col("epoch"))).alias("best_epoch"), F.max("metric").alias("best"), F.round(F.sum("metric"), 2).alias("total"))


@query(
    "SELECT run, epoch, CAST(sum(CASE WHEN better THEN 0 ELSE 1 END) OVER (PARTITION BY run, grp ORDER BY epoch) AS BIGINT) AS "
    "waited FROM (SELECT *, sum(CASE WHEN better THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch) AS grp FROM (SELECT *, "
    "coalesce(metric > max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS "
    "better FROM runs))", "runs")
def w16_early_stopping(spark, d):
    w = Window.partitionBy("run").orderBy("epoch")
    best = F.max("metric").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = P.runs(spark, d).withColumn("better", F.coalesce(F.col("metric") > best, F.lit(True)))
    rows = rows.withColumn("grp", F.sum(F.col("better").cast("int")).over(w))
    return rows.select("run", "epoch", F.sum((~F.col("better")).cast("int")).over(Window.partitionBy("run", "grp").orderBy("epoch")).alias("waited"))


# -- sets and store -------------------------------------------------------------------------------


@query("SELECT frame_idx FROM obs WHERE camera_id = 'cam_0' INTERSECT SELECT frame_idx FROM obs WHERE camera_id = 'cam_1'", "obs")
def o2_shared_frames(spark, d):
    obs = P.observations(spark, d)
    return obs.where("camera_id = 'cam_0'").select("frame_idx").intersect(obs.where("camera_id = 'cam_1'").select("frame_idx"))


@query("SELECT frame_idx FROM obs WHERE camera_id = 'cam_0' EXCEPT SELECT frame_idx FROM obs WHERE camera_id = 'cam_1'", "obs")
def o3_missing_frames(spark, d):
    obs = P.observations(spark, d)
    return obs.where("camera_id = 'cam_0'").select("frame_idx").subtract(obs.where("camera_id = 'cam_1'").select("frame_idx"))


@query("SELECT frame_idx // 100 AS chunk, camera_id, count(*) AS n, min(frame_idx % 100) AS first_local FROM obs GROUP BY ALL", "obs")
def o1_chunks(spark, d):
    return P.observations(spark, d).groupBy(F.expr("frame_idx div 100").alias("chunk"), "camera_id").agg(F.count("*").alias("n"), F.min(F.col("frame_idx") % 100).alias("first_local"))


@query(
    ", b AS (SELECT *, sample_id % 2 AS fresh FROM samples), k AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY "
    "priority DESC, fresh DESC, created DESC, sample_id DESC) AS rk, min(fresh) OVER (PARTITION BY content_hash) AS old FROM b) "
    "SELECT sample_id, content_hash, source, CASE WHEN old = 1 THEN 'inserted' WHEN fresh = 1 THEN 'upserted' ELSE 'kept' END AS "
    "action FROM k WHERE rk = 1", "samples")
def d1_upsert(spark, d):
    rows = P.samples(spark, d)
    return store.upsert(rows.where("sample_id % 2 = 0"), rows.where("sample_id % 2 = 1")).select("sample_id", "content_hash", "source", "action")


@query("SELECT sample_id FROM samples WHERE sample_id % 5 <> 0 AND coalesce(parent_id % 5 <> 0, true)", "samples")
def d3_cascade(spark, d):
    rows = P.samples(spark, d)
    return store.removed(rows, rows.where("sample_id % 5 = 0")).select("sample_id")


@query("SELECT sample_id, (excluded OR sample_id % 5 = 0 OR coalesce(parent_id % 5 = 0, false)) AS out FROM samples", "samples")
def d4_exclude(spark, d):
    rows = P.samples(spark, d)
    return store.excluded(rows, rows.where("sample_id % 5 = 0")).select("sample_id", F.array_contains("tags", "excluded").alias("out"))


@query("SELECT sample_id, source, created FROM samples WHERE lang = 'en' AND NOT excluded AND (confidence IS NULL OR confidence >= 0.5)", "samples")
def d5_query(spark, d):
    return P.samples(spark, d).where(store.matching(["en"], ["excluded"], 0.5)).orderBy("created", "sample_id").select("sample_id", "source", "created")


@query("SELECT source, count(*) AS n, count(*) FILTER (excluded) AS n_excluded, count(parent_id) AS n_augmented FROM samples GROUP BY source", "samples")
def a22_store_summary(spark, d):
    return store.summary(P.samples(spark, d))


@query(
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NULL OR "
    "CAST(json_extract(props, '$.k') AS BIGINT) >= 50"
)
def f35_json_filter(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return P.read(spark, d, "events").select("event_id", k.alias("k")).where("k IS NULL OR k >= 50")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(html) AS size FROM pages")
def s1_discover(spark, d):
    return P.read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.length("html").cast("bigint").alias("size"))


# -- graphs ---------------------------------------------------------------------------------------


def _edges(spark, d):
    """Cut once, as several steps read them."""
    return sequence.checkpointed(_scores(spark, d, 0.2).select(F.col("track_a").alias("src"), F.col("track_b").alias("dst"), F.col("score").alias("weight")))


def _nodes(spark, d):
    return P.observations(spark, d).select(F.col("track_id").alias("node")).distinct()


@query(_SCORE +
    ", e AS (SELECT track_a AS a, track_b AS b FROM score WHERE score >= 0.2 UNION SELECT track_b, track_a FROM score WHERE score >= "
    "0.2), walk AS (SELECT DISTINCT track_id AS node, track_id AS c FROM obs UNION SELECT e.b, walk.c FROM walk JOIN e ON e.a = "
    "walk.node) SELECT node, min(c) AS component FROM walk GROUP BY node", "obs")
def h2_components(spark, d):
    return graph.components(_nodes(spark, d), matching.affine_links(*_tracks(spark, d), 100.0, 3, 20, 3, 0.2))


ORACLE_SQL["h2_components"] = ORACLE_SQL["h2_components"].replace("WITH ", "WITH RECURSIVE ", 1)


def _communities(spark, d, edges):
    obs = P.observations(spark, d).withColumnRenamed("track_id", "node")
    return graph.communities(graph.components(_nodes(spark, d), edges), edges, lambda members: matching.must_not_share(obs, members))


@query()
def h3_communities(spark, d):
    return _communities(spark, d, _edges(spark, d))


@query()
def h5_cluster_confidence(spark, d):
    edges = _edges(spark, d)
    return graph.cluster_confidence(_communities(spark, d, edges).select("node", "community"), edges)


@query(
    ", now AS (SELECT camera_id, track_id, track_id // 4 AS local_id, min(frame_idx) * 1000 + track_id AS pos FROM obs WHERE "
    "frame_idx >= 300 GROUP BY camera_id, track_id), prev AS (SELECT DISTINCT camera_id, track_id, track_id // 5 AS global_id FROM "
    "obs WHERE frame_idx < 300 AND track_id % 3 > 0), v AS (SELECT local_id, global_id, count(*) AS n, min(pos) AS f FROM now LEFT "
    "JOIN prev USING (camera_id, track_id) GROUP BY ALL), b AS (SELECT local_id, global_id FROM (SELECT *, row_number() OVER "
    "(PARTITION BY local_id ORDER BY global_id IS NOT NULL DESC, n DESC, f) AS k FROM v) WHERE k = 1) SELECT local_id, global_id "
    "FROM b WHERE global_id IS NOT NULL UNION ALL SELECT local_id, 999 + row_number() OVER (ORDER BY local_id) FROM b WHERE "
    "global_id IS NULL", "obs")
def a27_stitch_identities(spark, d):
    obs = P.observations(spark, d)
    now = obs.where("frame_idx >= 300").groupBy("camera_id", "track_id").agg((F.min("frame_idx") * 1000 + F.col("track_id")).alias("pos")).withColumn("local_id", F.expr("track_id div 4"))
    prev = obs.where("frame_idx < 300 AND track_id % 3 > 0").select("camera_id", "track_id", F.expr("track_id div 5").alias("global_id")).distinct()
    return graph.stitched(now, prev, 1000)


# -- sweeps and reports ---------------------------------------------------------------------------


@query(_SCORE +
    ", g AS (SELECT unnest([0.1, 0.2, 0.3, 0.4]::DOUBLE[]) AS least) SELECT least, count(*) AS n_pairs, round(avg(score), 6) AS "
    "mean_score FROM score JOIN g ON score >= least GROUP BY least", "obs")
def c9_sweep(spark, d):
    """One pass scores all thresholds: each pair goes to the few grid points that it reaches."""
    least = (0.1, 0.2, 0.3, 0.4)
    grid = F.explode(F.array(*[F.lit(x) for x in least]))
    rows = _scores(spark, d, min(least)).select("score", grid.alias("least")).where("score >= least")
    return rows.groupBy("least").agg(F.count("*").alias("n_pairs"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(
    "SELECT camera_id, count(*) FILTER (status = 'detected') AS detected, count(*) FILTER (status = 'coasted') AS coasted, count(*) "
    "FILTER (status = 'interpolated') AS interpolated FROM obs GROUP BY camera_id", "obs")
def v2_pivot(spark, d):
    kinds = ["detected", "coasted", "interpolated"]
    out = P.observations(spark, d).groupBy("camera_id").pivot("status", kinds).count()
    return out.select("camera_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


# -- kernels --------------------------------------------------------------------------------------


@query()
def f8_fit_curve(spark, d):
    rows = P.polylines(spark, d).select("vec_id", F.posexplode("points").alias("i", "p")).select("vec_id", (F.col("i") / 31).alias("u"), "p.x", "p.y", F.lit(0.0).alias("z"))
    return reconstruction.curves(rows, ["vec_id"]).select("vec_id", r6("arc_length"))


@query()
def g2_tracker(spark, d):
    return tracking.track(P.detections(spark, d).select("camera_id", "frame_idx", "det_idx", "x", "y", "w", "h", "confidence"))
