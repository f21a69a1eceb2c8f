"""Further registered queries: refinement, labels, reports, splits and the store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import labelling, reconstruction, refinement, sequence
from ..sources import projections as P
from .queries import _ISLANDS, ORACLE_SQL, query, r6

_PAIRS = """, r AS (SELECT *, ray_id // 6 AS fish FROM rays), q AS (SELECT a.fish, a.ray_id AS ra, b.ray_id AS rb, a.ox AS px, a.oy AS py, a.oz AS pz, b.ox AS qx, b.oy AS qy, b.oz AS qz, a.dx AS ax, a.dy AS ay, a.dz AS az, b.dx AS bx, b.dy AS by_, b.dz AS bz FROM r a JOIN r b ON a.fish = b.fish AND a.ray_id < b.ray_id), t AS (SELECT *, ax*ax+ay*ay+az*az AS a, ax*bx+ay*by_+az*bz AS b, bx*bx+by_*by_+bz*bz AS c, ax*(px-qx)+ay*(py-qy)+az*(pz-qz) AS d, bx*(px-qx)+by_*(py-qy)+bz*(pz-qz) AS e FROM q), s AS (SELECT *, (b*e-c*d)/(a*c-b*b) AS s1, (a*e-b*d)/(a*c-b*b) AS s2 FROM t), pr AS (SELECT fish, ra, rb, (px+s1*ax+qx+s2*bx)/2 AS mx, (py+s1*ay+qy+s2*by_)/2 AS my, (pz+s1*az+qz+s2*bz)/2 AS mz, sqrt((px+s1*ax-qx-s2*bx)*(px+s1*ax-qx-s2*bx)+(py+s1*ay-qy-s2*by_)*(py+s1*ay-qy-s2*by_)+(pz+s1*az-qz-s2*bz)*(pz+s1*az-qz-s2*bz)) AS dist FROM s), co AS (SELECT fish, avg(mx) AS cx, avg(my) AS cy, avg(mz) AS cz FROM (SELECT *, row_number() OVER (PARTITION BY fish ORDER BY dist, ra, rb) AS k, count(*) OVER (PARTITION BY fish) AS n FROM pr) WHERE k <= greatest(1, n // 2) GROUP BY fish), ds AS (SELECT fish, ray_id, camera_id, sqrt(greatest(0, (cx-ox)*(cx-ox)+(cy-oy)*(cy-oy)+(cz-oz)*(cz-oz) - ((cx-ox)*dx+(cy-oy)*dy+(cz-oz)*dz)*((cx-ox)*dx+(cy-oy)*dy+(cz-oz)*dz)/(dx*dx+dy*dy+dz*dz))) AS dist FROM r JOIN co USING (fish))"""


def _rays(spark, d):
    return P.rays(spark, d).withColumn("fish", F.expr("ray_id div 6"))


def _pairs(spark, d):
    return refinement.ray_pairs(_rays(spark, d), ["fish"])


@query(_PAIRS + " SELECT fish, round(cx, 5) AS cx, round(cy, 5) AS cy, round(cz, 5) AS cz FROM co", "rays")
def a11_consensus(spark, d):
    return refinement.consensus(_pairs(spark, d), ["fish"]).select("fish", *[F.round(c, 5).alias(c) for c in ("cx", "cy", "cz")])


@query(_PAIRS + " SELECT camera_id, round(median(dist), 5) AS median FROM ds GROUP BY camera_id", "rays")
def a12_median_distance(spark, d):
    dist = refinement.distances(_rays(spark, d), refinement.consensus(_pairs(spark, d), ["fish"]), ["fish"])
    return dist.groupBy("camera_id").agg(F.round(F.expr("percentile(dist, 0.5)"), 5).alias("median"))


@query(_PAIRS + " SELECT fish, round(greatest(0, least(1, 1 - avg(dist) / 0.3)), 5) AS confidence FROM pr GROUP BY fish", "rays")
def a13_frame_confidence(spark, d):
    return refinement.confidence(_pairs(spark, d), ["fish"], 0.3).select("fish", F.round("confidence", 5).alias("confidence"))


_REFINED = _PAIRS + (
    ", m AS (SELECT fish, ray_id, camera_id, count(DISTINCT camera_id) OVER (PARTITION BY fish) AS cams, coalesce(dist, 1e9) > 0.15 AS far FROM ds), "
    "o AS (SELECT *, cams >= 3 AND far AS out0, count(*) FILTER (NOT (cams >= 3 AND far)) OVER (PARTITION BY fish) AS left_ FROM m), "
    "f AS (SELECT fish AS group_id, ray_id AS member, camera_id, false AS evicted, cams >= 3 AND left_ > 0 AS again FROM o WHERE NOT (out0 AND left_ > 0) UNION ALL "
    "SELECT (SELECT max(fish) FROM r) + row_number() OVER (ORDER BY fish, ray_id), ray_id, camera_id, true, false FROM o WHERE out0 AND left_ > 0)"
)


@query(_REFINED + " SELECT group_id, member, camera_id, evicted FROM f", "rays")
def a14_refine_groups(spark, d):
    rays = _rays(spark, d)
    dist = refinement.distances(rays, refinement.consensus(_pairs(spark, d), ["fish"]), ["fish"])
    members = dist.select(F.col("fish").alias("group_id"), F.col("ray_id").alias("member"), "camera_id")
    return refinement.refined(members, dist.select(F.col("fish").alias("group_id"), F.col("ray_id").alias("member"), "dist"), 0.15)


@query(
    _REFINED + ", w2 AS (SELECT fish, ray_id FROM r JOIN f ON f.member = r.ray_id AND f.group_id = r.fish AND f.again), "
    "k2 AS (SELECT pr.* FROM pr JOIN w2 x ON x.fish = pr.fish AND x.ray_id = pr.ra JOIN w2 y ON y.fish = pr.fish AND y.ray_id = pr.rb), "
    "t2 AS (SELECT fish, avg(mx) AS x, avg(my) AS y, avg(mz) AS z FROM (SELECT *, row_number() OVER (PARTITION BY fish ORDER BY dist, ra, rb) AS rk, count(*) OVER (PARTITION BY fish) AS np FROM k2) "
    "WHERE rk <= greatest(1, np // 2) GROUP BY fish), s2 AS (SELECT fish, greatest(0, least(1, 1 - avg(dist) / 0.15)) AS q FROM k2 GROUP BY fish) "
    "SELECT group_id, evicted, again AS refined, count(*) AS n, round(any_value(CASE WHEN evicted THEN 0.1 WHEN again THEN coalesce(q, 0) END), 5) AS confidence, "
    "round(any_value(CASE WHEN again THEN x END), 5) AS x, round(any_value(CASE WHEN again THEN y END), 5) AS y, round(any_value(CASE WHEN again THEN z END), 5) AS z "
    "FROM f LEFT JOIN t2 t ON t.fish = group_id AND again LEFT JOIN s2 s ON s.fish = group_id AND again GROUP BY ALL", "rays")
def a14_refined_consensus(spark, d):
    """The groups after eviction, with the consensus and confidence of what stayed, computed again."""
    return refinement.refined_groups(_rays(spark, d).withColumnRenamed("fish", "group_id"), 0.15)


_STEPS = (
    ", st AS (SELECT vec_id, label, i, x, y, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - "
    "lag(y) OVER w)), 0) AS step FROM pts WINDOW w AS (PARTITION BY vec_id ORDER BY i))"
)


def _steps(spark, d):
    w = Window.partitionBy("vec_id").orderBy("i")
    rows = P.polylines(spark, d).select("vec_id", "label", F.posexplode("points").alias("i", "p")).select("vec_id", "label", "i", "p.*")
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    return rows.withColumn("step", F.coalesce(step, F.lit(0.0)))


@query(_STEPS + " SELECT label, round(median(l), 6) AS median_length FROM (SELECT label, sum(step) AS l FROM st GROUP BY label, vec_id) GROUP BY label", "pts")
def a20_median_arc_length(spark, d):
    per = _steps(spark, d).groupBy("label", "vec_id").agg(F.sum("step").alias("l"))
    return per.groupBy("label").agg(F.round(F.expr("percentile(l, 0.5)"), 6).alias("median_length"))


@query(_STEPS +
    ", c AS (SELECT i, sum(step) OVER (PARTITION BY vec_id ORDER BY i) / sum(step) OVER (PARTITION BY vec_id) AS t FROM st) SELECT "
    "i, round(greatest(0, least(1, avg(t))), 4) AS t FROM c GROUP BY i", "pts")
def a21_t_values(spark, d):
    w = Window.partitionBy("vec_id")
    rows = _steps(spark, d).withColumn("t", F.sum("step").over(w.orderBy("i")) / F.sum("step").over(w))
    return rows.groupBy(F.col("i").cast("bigint").alias("i")).agg(F.round(G.clip(F.avg("t"), 0.0, 1.0), 4).alias("t"))


@query("SELECT frame_idx, camera_id, count(*) AS n FROM obs WHERE status = 'detected' GROUP BY ALL", "obs")
def a28_detected_counts(spark, d):
    return P.observations(spark, d).where("status = 'detected'").groupBy("frame_idx", "camera_id").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM samples WHERE NOT excluded GROUP BY source", "samples")
def a24_provenance(spark, d):
    return P.samples(spark, d).where(~F.array_contains("tags", "excluded")).groupBy("source").agg(F.count("*").alias("n"))


@query(_ISLANDS +
    ", f AS (SELECT m.camera_id, m.track_id, m.frame_idx, any_value(m.u) AS u, sum(w * q.u) AS smoothed FROM m JOIN p q ON q.camera_id = m.camera_id AND q.track_id = m.track_id AND q.island = m.island "
    "AND q.pos = CASE WHEN spot < m.n THEN spot ELSE 2 * m.n - 1 - spot END GROUP BY ALL) "
    "SELECT camera_id, track_id, round(avg(abs(u - p)) * 100, 5) AS jitter, round(avg(abs(smoothed - q)) * 100, 5) AS smoothed_jitter FROM (SELECT camera_id, track_id, u, smoothed, lag(u) OVER w AS p, "
    "lag(smoothed) OVER w AS q FROM f WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_idx)) WHERE p IS NOT NULL GROUP BY ALL", "obs")
def a32_jitter_of_series(spark, d):
    """The mean step of each track before and after it is smoothed."""
    return sequence.jitters(sequence.smooth(P.observations(spark, d), sequence.TRACK, "u"), sequence.TRACK, {"u": "jitter", "smoothed": "smoothed_jitter"})


@query(
    "SELECT camera_id, track_id, frame_idx, round(avg(v) OVER w, 6) AS mean_residual, count(*) OVER w AS held FROM obs WINDOW w AS "
    "(PARTITION BY camera_id, track_id ORDER BY frame_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "obs")
def g9_ring_buffer(spark, d):
    w = Window.partitionBy(*sequence.TRACK).orderBy("frame_idx").rowsBetween(-19, 0)
    return P.observations(spark, d).select(*sequence.TRACK, "frame_idx", F.round(F.avg("v").over(w), 6).alias("mean_residual"), F.count("*").over(w).alias("held"))


@query("SELECT frame_idx, camera_id, det_idx, round(w * 0.8 / 1400, 9) AS metres FROM det", "det")
def f9_half_width(spark, d):
    return P.detections(spark, d).select("frame_idx", "camera_id", "det_idx", F.round(G.half_width_metres(F.col("w"), F.lit(0.8), F.lit(1400.0)), 9).alias("metres"))


_TURN = "0.1::DOUBLE * (det_idx % 7)"
_SIDES = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
_TURNED_BOX = ", ".join(f"(x + w / 2 + {a} * w / 2 * cos(t) - {b} * h / 2 * sin(t)) / 1600 AS x{i}, (y + h / 2 + {a} * w / 2 * sin(t) + {b} * h / 2 * cos(t)) / 1200 AS y{i}" for i, (a, b) in enumerate(_SIDES))


@query(
    f", b AS (SELECT frame_idx, camera_id, det_idx, confidence, {_TURNED_BOX} FROM (SELECT *, {_TURN} AS t FROM det)), "
    "p AS (SELECT *, greatest(0, least(1, x0)) AS kx, greatest(0, least(1, y0)) AS ky, least(x0, x1, x2, x3) AS lx, greatest(x0, x1, x2, x3) AS hx, least(y0, y1, y2, y3) AS ly, greatest(y0, y1, y2, y3) AS hy FROM b) "
    "SELECT frame_idx, camera_id, det_idx, printf('0 %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', " + ", ".join(f"round(CAST({a}{i} AS DECIMAL(18, 9)), 6)::DOUBLE" for i in range(4) for a in "xy") + ") AS obb_line, "
    "printf('0 %.6f %.6f %.6f %.6f ', " + ", ".join(f"round(CAST(greatest(0, least(1, {c})) AS DECIMAL(18, 9)), 6)::DOUBLE" for c in ("(lx + hx) / 2", "(ly + hy) / 2", "hx - lx", "hy - ly")) + ") || "
    "CASE WHEN confidence > 0.95 THEN printf('%.6f %.6f 2', round(CAST(kx AS DECIMAL(18, 9)), 6)::DOUBLE, round(CAST(ky AS DECIMAL(18, 9)), 6)::DOUBLE) ELSE '0 0 0' END || ' 0 0 0' AS pose_line FROM p", "det")
def f30_label_lines(spark, d):
    """Lines of turned boxes: the four corners, and the upright box with a corner as its one keypoint, which only sure detections show."""
    turn = P.detections(spark, d).withColumn("t", F.col("det_idx") % 7 * 0.1)
    corner = lambda a, b: f"struct(x + w / 2 + {a} * w / 2 * cos(t) - {b} * h / 2 * sin(t) AS x, y + h / 2 + {a} * w / 2 * sin(t) + {b} * h / 2 * cos(t) AS y)"
    rows = turn.withColumn("box", F.expr(f"array({', '.join(corner(a, b) for a, b in _SIDES)})"))
    rows = rows.withColumn("points", F.expr("array(struct(box[0].x AS x, box[0].y AS y, confidence > 0.95 AS seen), struct(0D AS x, 0D AS y, false AS seen))"))
    line = labelling.obb_line(F.col("box"), F.lit(1600), F.lit(1200))
    return rows.select("frame_idx", "camera_id", "det_idx", line.alias("obb_line"), labelling.pose_line(F.col("box"), F.col("points"), 1600, 1200).alias("pose_line"))


@query("SELECT doc_id, sha256(text) AS content_hash, substr(sha256(text), 1, 16) AS short_hash FROM documents")
def f31_content_hash(spark, d):
    h = F.sha2("text", 256)
    return P.read(spark, d, "documents").select("doc_id", h.alias("content_hash"), F.substring(h, 1, 16).alias("short_hash"))


@query("SELECT o_orderkey, printf('%dh %02dm', CAST(floor(o_totalprice / 3600) AS BIGINT), CAST(floor(o_totalprice / 60) AS BIGINT) % 60) AS duration FROM orders")
def f33_durations(spark, d):
    s = F.col("o_totalprice")
    return P.read(spark, d, "orders").select("o_orderkey", F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s / 60) % 60).alias("duration"))


@query("SELECT run, best FROM (SELECT run, max(metric) AS best FROM runs GROUP BY run) ORDER BY best DESC, run LIMIT 3", "runs")
def t2_top_runs(spark, d):
    """The report of the three best runs: the limit is the feature."""
    return P.runs(spark, d).groupBy("run").agg(F.max("metric").alias("best")).orderBy(F.desc("best"), "run").limit(3)


@query(
    "SELECT frame_idx, camera_id, det_idx FROM (SELECT *, row_number() OVER (PARTITION BY frame_idx, camera_id ORDER BY confidence "
    "DESC, det_idx) AS k, count(*) OVER (PARTITION BY frame_idx, camera_id) AS n FROM det) WHERE k <= greatest(1, n // 2)", "det")
def t3_tightest_half(spark, d):
    w = Window.partitionBy("frame_idx", "camera_id")
    rows = P.detections(spark, d).withColumn("k", F.row_number().over(w.orderBy(F.desc("confidence"), "det_idx"))).withColumn("n", F.count("*").over(w))
    return rows.where("k <= greatest(1, n div 2)").select("frame_idx", "camera_id", "det_idx")


@query("SELECT run, epoch FROM (SELECT run, epoch, rank() OVER (PARTITION BY run ORDER BY metric DESC) AS k FROM runs) WHERE k = 1", "runs")
def t11_best_flags(spark, d):
    k = F.rank().over(Window.partitionBy("run").orderBy(F.desc("metric")))
    return P.runs(spark, d).withColumn("k", k).where("k = 1").select("run", "epoch")


@query("SELECT DISTINCT frame_idx FROM (SELECT frame_idx FROM obs WHERE camera_id = 'cam_0' UNION SELECT frame_idx FROM obs WHERE camera_id = 'cam_1')", "obs")
def o4_union_frames(spark, d):
    obs = P.observations(spark, d)
    return obs.where("camera_id IN ('cam_0', 'cam_1')").select("frame_idx").distinct()


@query(
    ", v AS (SELECT frame_idx AS id, camera_id, sum(w) AS w FROM det GROUP BY ALL), t AS (SELECT DISTINCT frame_idx AS id, 'cam_' || "
    "(track_id % 8) AS camera_id FROM obs) SELECT v.id, v.camera_id, CASE WHEN v.w < 60 THEN 'no-detection' WHEN t.id IS NULL THEN "
    "'no-tracklet' ELSE 'failed-midline' END AS reason FROM v LEFT JOIN t USING (id, camera_id)", "obs", "det")
def j11_classify_gaps(spark, d):
    v = P.detections(spark, d).groupBy(F.col("frame_idx").alias("id"), "camera_id").agg(F.sum("w").alias("w"))
    t = P.observations(spark, d).select(F.col("frame_idx").alias("id"), F.concat(F.lit("cam_"), (F.col("track_id") % 8).cast("string")).alias("camera_id")).distinct().withColumn("seen", F.lit(True))
    reason = F.when(F.col("w") < 60, "no-detection").when(F.col("seen").isNull(), "no-tracklet").otherwise("failed-midline")
    return v.join(t, ["id", "camera_id"], "left").select("id", "camera_id", reason.alias("reason"))


@query("SELECT s.sample_id, p.source AS parent_source FROM samples s LEFT JOIN samples p ON s.parent_id = p.sample_id WHERE s.parent_id IS NOT NULL", "samples")
def j9_parents(spark, d):
    rows = P.samples(spark, d)
    parents = rows.select(F.col("sample_id").alias("parent_id"), F.col("source").alias("parent_source"))
    return rows.where("parent_id IS NOT NULL").join(parents, "parent_id", "left").select("sample_id", "parent_source")


@query(
    "SELECT a.parent_id AS sample_id, count(*) AS children FROM samples a JOIN samples b ON a.parent_id = b.sample_id WHERE b.source "
    "<> 'pseudo' GROUP BY a.parent_id", "samples")
def d2_children(spark, d):
    rows = P.samples(spark, d)
    parents = rows.where("source <> 'pseudo'").select(F.col("sample_id").alias("parent_id"))
    return rows.join(parents, "parent_id", "left_semi").groupBy(F.col("parent_id").alias("sample_id")).agg(F.count("*").alias("children"))


@query(
    ", e AS (SELECT * FROM samples WHERE NOT excluded), k AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || sample_id), "
    "sample_id) AS rk FROM e WHERE source <> 'pseudo') SELECT e.sample_id, CASE WHEN k.rk <= (SELECT CAST(floor(count(*) * "
    "0.25::DOUBLE) AS BIGINT) FROM k) THEN 'val' ELSE 'train' END AS split FROM e LEFT JOIN k USING (sample_id)", "samples")
def d9_assemble(spark, d):
    """Eligible samples with a seeded split; pseudo-labelled ones are for training only.

    The split is by the least hashes; counts of their first digits are all that is gathered.
    """
    rows = P.samples(spark, d).where(~F.array_contains("tags", "excluded")).withColumn("h", F.md5(F.concat(F.lit("7:"), F.col("sample_id").cast("string"))))
    own = rows.where("source <> 'pseudo'")
    take = int(own.count() * 0.25)
    marked = sequence.smallest(own, "h", ["sample_id"], take).select(F.col("sample_id").alias("v"))
    out = rows.join(marked, F.col("sample_id") == F.col("v"), "left")
    return out.select("sample_id", F.when(F.col("v").isNull(), "train").otherwise("val").alias("split"))


@query(
    "SELECT n_name AS name, r_name AS region, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON "
    "c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())"
)
def a10_grouping_sets(spark, d):
    nation = F.broadcast(P.read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    region = F.broadcast(P.read(spark, d, "region").select("r_regionkey", "r_name"))
    rows = P.read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("region"), "c_acctbal")
    return rows.groupingSets([["region", "name"], ["region"], []], "region", "name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT camera_id, track_id, frame_idx + 300 AS frame_idx FROM obs", "obs")
def w14_shift_frames(spark, d):
    return P.observations(spark, d).select("camera_id", "track_id", (F.col("frame_idx") + 300).alias("frame_idx"))


@query("SELECT count(*) AS n, round(avg(CAST(status = 'detected' AS INT)), 6) AS detected FROM obs", "obs")
def s24_report(spark, d):
    return P.observations(spark, d).agg(F.count("*").alias("n"), F.round(F.avg((F.col("status") == "detected").cast("int")), 6).alias("detected")).select("n", r6("detected"))


#: The same sums as of all rays of a camera, of some rays of each eight.
_SOME = ORACLE_SQL["a18_triangulate"].split(", q AS ", 1)[1].replace("SELECT camera_id, ox", "SELECT ray_id // 8 AS camera_id, ox", 1).replace(" FROM rays)", " FROM rays WHERE ray_id * ray_id % 11 < 4)", 1)
_SOME = _SOME.replace("SELECT camera_id, sum", "SELECT camera_id, count(*) AS n, sum", 1).replace("GROUP BY camera_id)", "GROUP BY camera_id HAVING count(*) >= 2)", 1).replace("SELECT camera_id, round(", "SELECT camera_id AS fish, n, round(", 1)


@query(", q AS " + _SOME, "rays")
def a19_nearest_points(spark, d):
    """The point nearest to the rays of a group, where there are two."""
    rays = P.rays(spark, d).where("ray_id * ray_id % 11 < 4").withColumn("fish", F.expr("ray_id div 8"))
    return reconstruction.nearest_points(rays, ["fish"]).select("fish", "n", *[r6(c) for c in "xyz"])
