"""Registered queries of label generation, sweeps, the store, run discovery and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import curves as C
from ..functions import geometry as G
from ..functions import texts
from ..operators import lifecycle, matching, metrics, sequence
from ..operators import evaluation as E
from ..sources import projections as P
from .chain import _BASIS, _CAMERA, _CP, _PIXELS, _RIG, _newton, _pixels
from .queries import ORACLE_SQL, QUERIES, query, r6

# -- boxes and keypoints --------------------------------------------------------------------------

_PX = ", px AS (SELECT vec_id, i, 800 + 1000 * x AS x, 600 + 1000 * y AS y FROM pts WHERE i < 12), vis AS (SELECT * FROM px WHERE i % 3 > 0)"
_BOX = _PX + (
    ", m AS (SELECT vec_id, avg(x) AS cx, avg(y) AS cy, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS t FROM vis "
    "GROUP BY vec_id), b AS (SELECT m.*, ext FROM m JOIN (SELECT vec_id, max(abs((x - cx) * cos(t) + (y - cy) * sin(t))) + 2 AS ext "
    "FROM vis JOIN m USING (vec_id) GROUP BY vec_id) USING (vec_id)), c AS (SELECT vec_id, CAST(k AS BIGINT) AS k, cx + a * ext * "
    "cos(t) - s * 15 * sin(t) AS x, cy + a * ext * sin(t) + s * 15 * cos(t) AS y FROM b, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), "
    "(3, -1, 1)) AS w(k, a, s))"
)


def _keypoints(spark, d):
    points = "transform(slice(points, 1, 12), p -> struct(800 + 1000 * p.x AS x, 600 + 1000 * p.y AS y))"
    rows = P.polylines(spark, d).select("vec_id", F.expr(points).alias("points"))
    return rows.withColumn("seen", F.filter("points", lambda p, i: i % 3 > 0))


def _exploded(rows, name):
    return rows.select("vec_id", F.posexplode(name).alias("k", "p")).select("vec_id", F.col("k").cast("bigint").alias("k"), F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


@query(_BOX + " SELECT vec_id, k, round(x, 5) AS x, round(y, 5) AS y FROM c", "pts")
def f14_principal_boxes(spark, d):
    return _exploded(_keypoints(spark, d).withColumn("box", F.expr(G.principal_box("seen", 15.0))), "box")


@query(_BOX + " SELECT vec_id, k, round(greatest(0, least(899, x)), 5) AS x, round(greatest(0, least(699, y)), 5) AS y FROM c", "pts")
def f16_clipped_boxes(spark, d):
    rows = _keypoints(spark, d).withColumn("box", F.expr(G.principal_box("seen", 15.0)))
    return _exploded(rows.withColumn("box", F.expr(G.clipped("box", 900, 700))), "box")


@query(
    _PX
    +
        ", e AS (SELECT vec_id, i, x, y, i IN (1, 11) AND least(x, y, 900 - x, 700 - y) < 60 AS near FROM vis), f AS (SELECT *, [x, "
        "899 - x, y, 699 - y] AS far FROM e), s AS (SELECT *, list_position(far, list_min(far)) AS side FROM f) SELECT vec_id, i, "
        "round(CASE WHEN near AND side = 1 THEN 0 WHEN near AND side = 2 THEN 899 ELSE x END, 5) AS x, round(CASE WHEN near AND side "
        "= 3 THEN 0 WHEN near AND side = 4 THEN 699 ELSE y END, 5) AS y FROM s",
    "pts",
)
def f17_edge_keypoints(spark, d):
    """The first and the last visible keypoint go to the image's border where that is near; fewer than two stay."""
    rows = _keypoints(spark, d).select("vec_id", F.expr("filter(transform(points, (p, i) -> struct(i, p.x AS x, p.y AS y)), p -> p.i % 3 > 0)").alias("seen"))
    new = f"transform(seen, (p, k) -> IF(size(seen) >= 2 AND k IN (0, size(seen) - 1), {G.snapped('p.x', 'p.y', 900, 700, 60.0)}, struct(p.x AS x, p.y AS y)))"
    out = rows.select("vec_id", F.arrays_zip(F.col("seen.i").alias("i"), F.expr(new).alias("p")).alias("z")).select("vec_id", F.explode("z").alias("z"))
    return out.select("vec_id", F.col("z.i").cast("bigint").alias("i"), F.round("z.p.x", 5).alias("x"), F.round("z.p.y", 5).alias("y"))


_BENT = _PX + (
    ", g AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM px WINDOW w AS "
    "(PARTITION BY vec_id ORDER BY i)), h AS (SELECT vec_id, i, x, y, sum(step) OVER (PARTITION BY vec_id ORDER BY i) / sum(step) "
    "OVER (PARTITION BY vec_id) AS t, max(x) FILTER (i = 11) OVER v - max(x) FILTER (i = 0) OVER v AS nx, max(y) FILTER (i = 11) "
    "OVER v - max(y) FILTER (i = 0) OVER v AS ny FROM g WINDOW v AS (PARTITION BY vec_id))"
)


def _bent_sql(profile: str) -> str:
    return _BENT + f", e AS (SELECT *, {profile} AS d FROM h), m AS (SELECT *, d - avg(d) OVER (PARTITION BY vec_id) AS r FROM e) SELECT vec_id, i AS k, round(x - ny * r, 5) AS x, round(y + nx * r, 5) AS y FROM m"


def _bent(spark, d, profile):
    rows = _keypoints(spark, d).withColumn("t", F.expr(C.arc_lengths("points")))
    return _exploded(rows.withColumn("bent", F.expr(G.bent("points", "t", profile))), "bent")


@query(_bent_sql("tan(radians(10)) * 4 * t * (1 - t)"), "pts")
def f19_bent_one_way(spark, d):
    return _bent(spark, d, "tan(radians(10D)) * 4 * t * (1 - t)")


@query(_bent_sql("0.5 * tan(radians(10)) * sin(2 * pi() * t)"), "pts")
def f19_bent_both_ways(spark, d):
    return _bent(spark, d, "0.5D * tan(radians(10D)) * sin(2 * pi() * t)")


# -- labels and datasets --------------------------------------------------------------------------

_LABEL = _BASIS + _CP + _PIXELS + (
    ", v AS (SELECT vec_id, u >= 700 AND u < 900 AND v >= 500 AND v < 700 AS ok, u, v FROM pix), g AS (SELECT vec_id, count(*) "
    "FILTER (ok) AS n_visible, min(u) FILTER (ok) AS u0, max(u) FILTER (ok) AS u1, min(v) FILTER (ok) AS v0, max(v) FILTER (ok) AS "
    "v1 FROM v GROUP BY vec_id HAVING count(*) FILTER (ok) >= 2 AND count(*) FILTER (ok) >= 0.5 * count(*))"
)


@query("WITH vals AS (SELECT 1)" + _LABEL +
    ", r AS (SELECT l_orderkey % 1000 AS vec_id, avg(l_quantity) AS residual FROM lineitem GROUP BY 1) SELECT g.vec_id, n_visible, "
    "round((u0 + u1) / 2 / 1600, 6) AS cx, round((v0 + v1) / 2 / 1200, 6) AS cy, round((u1 - u0) / 1600, 6) AS w, round((v1 - v0) / "
    "1200, 6) AS h FROM g JOIN r USING (vec_id) WHERE residual <= 26"
)
def d11_fish_labels(spark, d):
    """Label boxes of reprojected curves: enough points in the image, half of all at least, and a camera that fits well."""
    ok = "u >= 700 AND u < 900 AND v >= 500 AND v < 700"
    rows = _pixels(spark, d).withColumn("ok", F.expr(ok))
    seen = lambda f, c: f(F.when(F.col("ok"), F.col(c)))
    per = rows.groupBy("vec_id").agg(F.count_if("ok").alias("n_visible"), F.count("*").alias("n"), seen(F.min, "u").alias("u0"), seen(F.max, "u").alias("u1"), seen(F.min, "v").alias("v0"), seen(F.max, "v").alias("v1"))
    fit = P.read(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 1000).alias("vec_id")).agg(F.avg("l_quantity").alias("residual")).where("residual <= 26")
    good = per.where("n_visible >= 2 AND n_visible >= 0.5 * n").join(fit, "vec_id", "left_semi")
    box = {"cx": (F.col("u0") + F.col("u1")) / 2 / 1600, "cy": (F.col("v0") + F.col("v1")) / 2 / 1200, "w": (F.col("u1") - F.col("u0")) / 1600, "h": (F.col("v1") - F.col("v0")) / 1200}
    return good.select("vec_id", "n_visible", *[F.round(c, 6).alias(n) for n, c in box.items()])


_CROPS = (
    ", b AS (SELECT frame_idx, camera_id, det_idx, x, y, w, h, x + w / 2 AS mx, y + h / 2 AS my FROM det), s AS (SELECT frame_idx, "
    "camera_id, row_number() OVER (ORDER BY md5('42:' || frame_idx || camera_id), frame_idx, camera_id) AS rk, count(*) OVER () AS n "
    "FROM (SELECT DISTINCT frame_idx, camera_id FROM det))"
)


@query(_CROPS +
    " SELECT c.frame_idx, c.camera_id, c.det_idx AS crop, o.det_idx AS inside, CASE WHEN n > 1 AND rk <= greatest(1, CAST(floor(n * "
    "0.2::DOUBLE) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM b c JOIN b o ON c.frame_idx = o.frame_idx AND c.camera_id = "
    "o.camera_id AND o.mx BETWEEN c.x - 100 AND c.x + c.w + 100 AND o.my BETWEEN c.y - 100 AND c.y + c.h + 100 JOIN s ON s.frame_idx "
    "= c.frame_idx AND s.camera_id = c.camera_id", "det")
def d10_pose_crops(spark, d):
    """Each crop with all that is visible in it, split by image: a share of the images by a seeded hash is for validation, one at least if there are two."""
    boxes = P.detections(spark, d).select("frame_idx", "camera_id", "det_idx", "x", "y", "w", "h")
    images = boxes.select("frame_idx", "camera_id").distinct().withColumn("h", F.md5(F.concat(F.lit("42:"), F.col("frame_idx").cast("string"), "camera_id")))
    n = images.count()
    take = max(1, int(n * 0.2)) if n > 1 else 0
    val = sequence.smallest(images, "h", ["frame_idx", "camera_id"], take).select("frame_idx", "camera_id", F.lit("val").alias("split"))
    pairs = matching.in_crops(boxes.join(val, ["frame_idx", "camera_id"], "left"), 100.0, ["split"])
    return pairs.select("frame_idx", "camera_id", "crop", "inside", F.coalesce("split", F.lit("train")).alias("split"))


@query(
    "SELECT i.doc_id, i.path AS image, l.path AS label FROM (SELECT doc_id, 'images/' || lang || '/' || doc_id || '.png' AS path "
    "FROM documents) i JOIN (SELECT DISTINCT doc_id, 'labels/' || lang || '/' || doc_id || '.txt' AS path FROM documents SEMI JOIN "
    "labels USING (doc_id)) l ON regexp_extract(i.path, '^images/(.*)[.]png$', 1) = regexp_extract(l.path, '^labels/(.*)[.]txt$', 1)"
)
def j16_image_label_pairs(spark, d):
    docs, labels = P.read(spark, d, "documents").select("doc_id", "lang"), P.read(spark, d, "labels").select("doc_id")
    path = lambda kind, end: F.concat(F.lit(f"{kind}/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(end))
    images = docs.select("doc_id", path("images", ".png").alias("image")).withColumn("stem", F.regexp_extract("image", r"^images/(.*)[.]png$", 1))
    texts = docs.join(labels, "doc_id", "left_semi").distinct().select(path("labels", ".txt").alias("label")).withColumn("stem", F.regexp_extract("label", r"^labels/(.*)[.]txt$", 1))
    return images.join(texts, "stem").select("doc_id", "image", "label")


@query(
    "SELECT doc_id, q IS NOT NULL AS has_sidecar, CASE WHEN q IS NOT NULL THEN CAST(q AS VARCHAR) END AS confidence, 'import' AS "
    "source, CASE WHEN q IS NOT NULL THEN CAST(t AS VARCHAR) END AS toxic FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS "
    "q, max(toxic) AS t FROM labels GROUP BY doc_id) USING (doc_id)"
)
def j15_sidecar_metadata(spark, d):
    """Metadata from the sidecar of the same stem; static keys win over those of the sidecar."""
    sidecar = P.read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("q"), F.max("toxic").cast("string").alias("t"))
    sidecar = sidecar.select("doc_id", F.create_map(F.lit("confidence"), F.col("q"), F.lit("source"), F.lit("model"), F.lit("toxic"), F.col("t")).alias("side"))
    static = F.create_map(F.lit("source"), F.lit("import"))
    rows = P.read(spark, d, "documents").select("doc_id").join(sidecar, "doc_id", "left").withColumn("static", static)
    meta = F.coalesce(F.map_concat(F.map_filter("side", lambda k, _: ~F.map_contains_key("static", k)), "static"), F.col("static"))
    return rows.select("doc_id", F.col("side").isNotNull().alias("has_sidecar"), *[F.try_element_at(meta, F.lit(k)).alias(k) for k in ("confidence", "source", "toxic")])


@query("SELECT page_id FROM (SELECT page_id FROM pages ORDER BY md5('9:' || page_id), page_id LIMIT 20)")
def t8_random_sample(spark, d):
    """Twenty files by a seeded hash: the limit is the feature."""
    pages = P.read(spark, d, "pages").select("page_id")
    return pages.orderBy(F.md5(F.concat(F.lit("9:"), F.col("page_id").cast("string"))), "page_id").limit(20)


# -- chunks and frames ----------------------------------------------------------------------------


@query(
    "SELECT frame_idx // 100 AS chunk, camera_id, track_id, frame_idx, u, CASE WHEN frame_idx >= 100 THEN v END AS v FROM obs WHERE camera_id IN (SELECT camera_id FROM obs WHERE frame_idx < 100)", "obs")
def o1_merged_chunks(spark, d):
    """All chunks one after the other: frames counted on from the first, its cameras, and columns that a chunk lacks, as the first one, are null."""
    local = P.observations(spark, d).withColumns({"chunk": F.expr("frame_idx div 100"), "frame_idx": F.col("frame_idx") % 100})
    first = local.where("chunk = 0").select("chunk", "camera_id", "track_id", "frame_idx", "u")
    rest = local.where("chunk > 0").select("chunk", "camera_id", "track_id", "frame_idx", "u", "v")
    merged = first.unionByName(rest, allowMissingColumns=True).withColumn("frame_idx", F.col("frame_idx") + 100 * F.col("chunk"))
    return merged.join(first.select("camera_id").distinct(), "camera_id", "left_semi").select("chunk", "camera_id", "track_id", "frame_idx", "u", "v")


@query("SELECT frame_idx // 100 AS chunk, camera_id, track_id, frame_idx % 100 AS frame_idx FROM obs", "obs")
def w15_rebased(spark, d):
    """The frames of each chunk counted from its start."""
    return P.observations(spark, d).select(F.expr("frame_idx div 100").alias("chunk"), "camera_id", "track_id", (F.col("frame_idx") % 100).alias("frame_idx"))


@query("SELECT camera_id, track_id, frame_idx FROM obs WHERE frame_idx // 100 < 2", "obs")
def t10_first_chunks(spark, d):
    return P.observations(spark, d).where("frame_idx div 100 < 2").select("camera_id", "track_id", "frame_idx")


_CHUNKS = (
    ", n AS (SELECT max(frame_idx) + 1 AS total FROM obs), k AS (SELECT k, k * 64 AS s, least(k * 64 + 64, total) AS e FROM n, "
    "(SELECT unnest(range(0, 100000)) AS k) WHERE k * 64 < total), c AS (SELECT frame_idx // 64 AS k, count(*) FILTER (status = "
    "'coasted') * 4 > count(*) AS failed FROM obs GROUP BY 1)"
)


@query(_CHUNKS +
    " SELECT k.k AS chunk, s AS start, e AS stop, coalesce(failed, false) AS failed, CAST(sum(CASE WHEN coalesce(failed, false) THEN "
    "1 ELSE 0 END) OVER (ORDER BY k.k) AS BIGINT) AS ids_skipped, total FROM k LEFT JOIN c USING (k), n", "obs")
def s16_chunk_ranges(spark, d):
    """Ranges of all chunks, which failed, ids skipped after each failure (one a chunk), and the total of frames.

    A row a chunk: there are as many as the run has chunks, so one ordered window over them is small.
    """
    obs = P.observations(spark, d)
    total = obs.agg((F.max("frame_idx") + 1).alias("total"))
    ranges = total.select("total", F.explode(F.expr("sequence(0L, (total - 1) div 64)")).alias("chunk"))
    failed = obs.groupBy(F.expr("frame_idx div 64").alias("chunk")).agg((F.count_if(F.col("status") == "coasted") * 4 > F.count("*")).alias("failed"))
    rows = ranges.join(failed, "chunk", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    skipped = F.sum(F.col("failed").cast("int")).over(Window.partitionBy("total").orderBy("chunk"))
    return rows.select("chunk", (F.col("chunk") * 64).alias("start"), F.least(F.col("chunk") * 64 + 64, F.col("total")).alias("stop"), "failed", skipped.alias("ids_skipped"), "total")


_SLOT = (
    "SELECT frame_idx, max(CASE WHEN slot = 0 THEN fish_id ELSE -1 END) AS s0, max(CASE WHEN slot = 1 THEN fish_id ELSE -1 END) AS "
    "s1, max(CASE WHEN slot = 2 THEN fish_id ELSE -1 END) AS s2 FROM (SELECT frame_idx, track_id AS fish_id, row_number() OVER "
    "(PARTITION BY frame_idx ORDER BY track_id) - 1 AS slot FROM obs) WHERE slot < 3 GROUP BY frame_idx"
)


def _dense(spark, d):
    slot = F.row_number().over(Window.partitionBy("frame_idx").orderBy("track_id")) - 1
    rows = P.observations(spark, d).select("frame_idx", F.col("track_id").alias("fish_id"), slot.alias("slot")).where("slot < 3")
    return rows.groupBy("frame_idx").pivot("slot", [0, 1, 2]).agg(F.max("fish_id")).select("frame_idx", *[F.coalesce(str(k), F.lit(-1)).cast("bigint").alias(f"s{k}") for k in range(3)])


@query(_SLOT, "obs")
def s12_dense_frames(spark, d):
    """A row a frame with fixed slots, by id; what is beyond the slots is left out, empty slots are -1."""
    return _dense(spark, d)


@query(", dense AS (" + _SLOT +
    ") SELECT frame_idx, slot, fish_id FROM (SELECT frame_idx, unnest([0, 1, 2]) AS slot, unnest([s0, s1, s2]) AS fish_id FROM "
    "dense) WHERE fish_id >= 0", "obs")
def s13_frames_to_rows(spark, d):
    rows = _dense(spark, d).unpivot("frame_idx", ["s0", "s1", "s2"], "slot", "fish_id").where("fish_id >= 0")
    return rows.select("frame_idx", F.substring("slot", 2, 1).cast("int").alias("slot"), "fish_id")


# -- sets and lookups -----------------------------------------------------------------------------


@query("SELECT DISTINCT camera_id FROM (SELECT camera_id FROM obs WHERE status = 'coasted' UNION SELECT camera_id FROM det WHERE confidence > 0.95)", "obs", "det")
def o5_cameras_wanted(spark, d):
    a = P.observations(spark, d).where("status = 'coasted'").select("camera_id")
    return a.union(P.detections(spark, d).where("confidence > 0.95").select("camera_id")).distinct()


@query(
    ", s AS (SELECT track_id, list(frame_idx) AS f FROM obs WHERE status = 'detected' GROUP BY track_id) SELECT a.track_id AS "
    "track_a, b.track_id AS track_b, list_has_any(a.f, b.f) AS overlap FROM s a JOIN s b ON b.track_id = a.track_id + 5", "obs")
def o6_overlapping_tracks(spark, d):
    """Two tracks overlap if one frame of both is met; no track's frames come together in a row."""
    seen = P.observations(spark, d).where("status = 'detected'").select("track_id", "frame_idx").distinct()
    tracks = seen.select("track_id").distinct()
    a, b = tracks.select(F.col("track_id").alias("track_a"), (F.col("track_id") + 5).alias("track_b")), tracks.withColumnRenamed("track_id", "track_b")
    ahead = seen.select((F.col("track_id") - 5).alias("track_id"), "frame_idx")
    hit = seen.join(ahead, ["track_id", "frame_idx"]).select(F.col("track_id").alias("track_a")).distinct().withColumn("overlap", F.lit(True))
    return a.join(b, "track_b").join(hit, "track_a", "left").select("track_a", "track_b", F.coalesce("overlap", F.lit(False)).alias("overlap"))


@query(
    ", now AS (SELECT DISTINCT camera_id, track_id FROM obs WHERE frame_idx >= 300), prev AS (SELECT DISTINCT camera_id, track_id, "
    "track_id // 5 AS global_id FROM obs WHERE frame_idx < 300 AND track_id % 3 > 0) SELECT camera_id, track_id, global_id FROM now "
    "LEFT JOIN prev USING (camera_id, track_id)", "obs")
def j9_track_continuity(spark, d):
    obs = P.observations(spark, d)
    now = obs.where("frame_idx >= 300").select("camera_id", "track_id").distinct()
    before = obs.where("frame_idx < 300 AND track_id % 3 > 0").select("camera_id", "track_id", F.expr("track_id div 5").alias("global_id")).distinct()
    return now.join(before, ["camera_id", "track_id"], "left")


_VOXELS = f", cams AS (SELECT c AS camera_id, (c % 3 - 1) * 0.4::DOUBLE AS px, (c // 3 - 1) * 0.4::DOUBLE AS py FROM (SELECT unnest(range(9)) AS c)), vox AS (SELECT ix, iy, iz, -0.5::DOUBLE + 0.05::DOUBLE * ix AS x, -0.5::DOUBLE + 0.05::DOUBLE * iy AS y, 0.8::DOUBLE + 0.1::DOUBLE * iz AS z FROM (SELECT unnest(range(21)) AS ix), (SELECT unnest(range(21)) AS iy), (SELECT unnest(range(4)) AS iz)), g AS (SELECT ix, iy, iz, camera_id, x - px AS dx, y - py AS dy, z - 0.75::DOUBLE AS depth, 0.75::DOUBLE AS air, sqrt((x-px)*(x-px) + (y-py)*(y-py)) AS r FROM vox, cams), p AS (SELECT *, CASE WHEN r > 0 THEN {_newton('r', 'depth', 'air')} / r ELSE 0 END / air AS scale FROM g), inv AS (SELECT ix, iy, iz, camera_id, 800 + 1400 * dx * scale AS u, 600 + 1400 * dy * scale AS v FROM p WHERE 800 + 1400 * dx * scale BETWEEN 0 AND 1599.999 AND 600 + 1400 * dy * scale BETWEEN 0 AND 1199.999)"


@query(_VOXELS +
    ", k AS (SELECT ray_id, CAST(round_even((ox + 0.5) / 0.05, 0) AS BIGINT) AS ix, CAST(round_even((oy + 0.5) / 0.05, 0) AS BIGINT) "
    "AS iy, CAST(round_even((abs(oz) + 0.8 - 0.8) / 0.1, 0) AS BIGINT) AS iz FROM rays) SELECT ray_id, camera_id, round(u, 5) AS u, "
    "round(v, 5) AS v FROM k JOIN inv USING (ix, iy, iz)", "rays")
def j12_ghost_points(spark, d):
    """Where the cameras would see each point: its voxel, rounded half to even, looked up in a table of visible pixels; outside there is none."""
    voxels = spark.range(21 * 21 * 4).select((F.col("id") % 21).alias("ix"), F.expr("id div 21 % 21").alias("iy"), F.expr("id div 441").alias("iz"))
    rig = spark.range(9).select(F.col("id").alias("camera_id"), ((F.col("id") % 3 - 1) * 0.4).alias("px"), (F.expr("id div 3 - 1") * 0.4).alias("py"))
    at = voxels.crossJoin(F.broadcast(rig)).withColumns({"x": -0.5 + 0.05 * F.col("ix"), "y": -0.5 + 0.05 * F.col("iy"), "z": 0.8 + 0.1 * F.col("iz")})  # a grid times nine cameras
    u, v = G.project(G.vec("x", "y", "z"), centre=(F.col("px"), F.col("py"), F.lit(0.0)), **_CAMERA)
    table = at.select("ix", "iy", "iz", "camera_id", u.alias("u"), v.alias("v")).where("u BETWEEN 0 AND 1599.999 AND v BETWEEN 0 AND 1199.999")
    key = lambda c, low, size: matching.voxel_key(c, low, size)
    points = P.rays(spark, d).select("ray_id", key(F.col("ox"), -0.5, 0.05).alias("ix"), key(F.col("oy"), -0.5, 0.05).alias("iy"), key(F.abs("oz") + 0.8, 0.8, 0.1).alias("iz"))
    return points.join(table, ["ix", "iy", "iz"]).select("ray_id", "camera_id", F.round("u", 5).alias("u"), F.round("v", 5).alias("v"))


# -- sweeps ---------------------------------------------------------------------------------------

_SWEEP = """, both_ AS (SELECT a.camera_id AS ca, a.track_id AS ta, b.camera_id AS cb, b.track_id AS tb, sqrt((a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v)) AS dist FROM obs a JOIN obs b ON a.frame_idx = b.frame_idx AND a.camera_id < b.camera_id), sums AS (SELECT ca, ta, cb, tb, tau, count(*) AS n, sum(CASE WHEN dist < tau THEN 1 - dist / tau ELSE 0 END) AS total, avg(dist) AS dist FROM both_, (SELECT unnest([60, 100, 140]) AS tau) GROUP BY ALL), combo AS (SELECT tau, least, t_min, count(*) AS n_pairs, round(avg(dist), 6) AS error FROM sums, (SELECT unnest([0.02, 0.05, 0.1]::DOUBLE[]) AS least), (SELECT unnest([2, 3, 5]) AS t_min) WHERE n >= t_min AND total / n * least(n, 20) / 20 >= least GROUP BY ALL),
joint AS (SELECT * FROM combo WHERE t_min = 3), best AS (SELECT tau AS bt, least AS bl FROM joint ORDER BY n_pairs DESC, error, tau, least LIMIT 1), next AS (SELECT combo.* FROM combo, best WHERE tau = bt AND least = bl)"""


@query(_SWEEP +
    " SELECT 'joint' AS sweep, tau, least, t_min, n_pairs, round(error, 6) AS error FROM joint UNION ALL SELECT 't_min', tau, least, "
    "t_min, n_pairs, round(error, 6) FROM next", "obs")
def c9_association_sweep(spark, d):
    """A joint grid of two parameters, then a third with the best of them carried on; the score is most pairs, then least error.

    One pass over blocks of tracks serves all combinations.
    """
    obs = sequence.checkpointed(P.observations(spark, d))
    seen = obs.select("camera_id").distinct()
    rig = seen.select(F.col("camera_id").alias("camera_a")).join(F.broadcast(seen.select(F.col("camera_id").alias("camera_b"))), F.expr("camera_a < camera_b"))  # a row a camera
    grid = [(t, x, m) for t in (60, 100, 140) for x in (0.02, 0.05, 0.1) for m in (2, 3, 5)]
    sums = matching.swept(obs, rig, grid, 20)
    combos = sums.groupBy("tau", "least", "t_min").agg(F.sum("n_pairs").alias("n_pairs"), F.round(F.sum("total") / F.sum("n_pairs"), 6).alias("error"))  # rounded, so that ties are ties in any order of sums
    joint = combos.where("t_min = 3")
    best = joint.agg(F.min(F.struct((-F.col("n_pairs")).alias("k"), "error", "tau", "least")).alias("b"))  # one row
    following = combos.join(F.broadcast(best), F.expr("tau = b.tau AND least = b.least"))
    cells = [F.col("tau").cast("int").alias("tau"), "least", F.col("t_min").cast("int").alias("t_min"), "n_pairs", F.round("error", 6).alias("error")]
    return joint.select(F.lit("joint").alias("sweep"), *cells).unionAll(following.select(F.lit("t_min"), *cells))


_RECON = (
    ", g AS (SELECT k, 5 + 2.5::DOUBLE * k AS threshold FROM (SELECT unnest(range(19)) AS k)), tune AS (SELECT k, threshold, avg(w) "
    "AS error, count(*)::DOUBLE / (SELECT count(*) FROM det WHERE frame_idx % 10 = 0) AS coverage FROM det, g WHERE frame_idx % 10 = "
    "0 AND w <= threshold GROUP BY ALL), top AS (SELECT k, threshold FROM tune WHERE coverage >= 0.5 ORDER BY error, coverage DESC, "
    "k LIMIT 3)"
)


@query(_RECON +
    " SELECT k, threshold, round(avg(w), 6) AS error, round(count(*)::DOUBLE / (SELECT count(*) FROM det), 6) AS coverage FROM det, "
    "top WHERE w <= threshold GROUP BY ALL", "det")
def c10_reconstruction_sweep(spark, d):
    """Nineteen thresholds over a tenth of the frames, and the best three again over all; the score is least error, then most coverage."""
    boxes = P.detections(spark, d).select("frame_idx", "w")
    grid = [(k, 5 + 2.5 * k) for k in range(19)]

    def swept(rows, pairs):
        n = rows.count()
        cells = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(t).alias("threshold")) for k, t in pairs]))
        hit = rows.select("w", cells.alias("g")).where("w <= g.threshold")
        return hit.groupBy("g.k", "g.threshold").agg(F.avg("w").alias("error"), (F.count("*").cast("double") / n).alias("coverage"))

    tuned = swept(boxes.where("frame_idx % 10 = 0"), grid).where("coverage >= 0.5")
    top = [(r.k, r.threshold) for r in tuned.orderBy("error", F.desc("coverage"), "k").limit(3).collect()]  # three rows
    return swept(boxes, top or grid[:1]).select("k", "threshold", r6("error"), r6("coverage"))


@query(
    ", s AS (SELECT camera_id, count(*) AS n, avg(w) AS error FROM det GROUP BY camera_id) SELECT camera_id, n, round(error, 6) AS "
    "error, row_number() OVER (ORDER BY n DESC, error, camera_id) = 1 AS best FROM s", "det")
def c11_score_order(spark, d):
    """Scores are compared as pairs: most first, then least error."""
    s = P.detections(spark, d).groupBy("camera_id").agg(F.count("*").alias("n"), F.avg("w").alias("error"))
    top = s.agg(F.min_by("camera_id", F.struct((-F.col("n")).alias("k"), "error", "camera_id")).alias("top"))
    return s.crossJoin(F.broadcast(top)).select("camera_id", "n", r6("error"), (F.col("camera_id") == F.col("top")).alias("best"))  # one row


# -- store ----------------------------------------------------------------------------------------


@query("SELECT -sample_id - 1 AS sample_id, source, sample_id AS parent_id, lang || ',augmented' AS tags FROM samples WHERE sample_id % 10 = 0", "samples")
def d2_augmented(spark, d):
    """Children of known parents: they take their source and tags, and one tag more; unknown parents are an error, found by an anti join."""
    rows = P.samples(spark, d)
    asked = spark.range(0, rows.count(), 10).select(F.col("id").alias("sample_id"))
    if asked.join(rows, "sample_id", "left_anti").limit(1).count():
        raise ValueError("unknown parents")
    tags = F.array_join(F.array_append(F.filter("tags", lambda t: t != "excluded"), F.lit("augmented")), ",")
    return rows.join(asked, "sample_id", "left_semi").select((-F.col("sample_id") - 1).alias("sample_id"), "source", F.col("sample_id").alias("parent_id"), tags.alias("tags"))


@query("SELECT sample_id, excluded AND sample_id % 5 <> 0 AND coalesce(parent_id % 5 <> 0, true) AS out FROM samples", "samples")
def d4_include(spark, d):
    """Restored samples and their children lose the tag."""
    back = (F.col("sample_id") % 5 == 0) | F.coalesce(F.col("parent_id") % 5 == 0, F.lit(False))
    rows = P.samples(spark, d).withColumn("tags", F.when(back, F.array_remove("tags", "excluded")).otherwise(F.col("tags")))
    return rows.select("sample_id", F.array_contains("tags", "excluded").alias("out"))


@query("SELECT sample_id, source, content_hash FROM samples WHERE sample_id = 42", "samples")
def d6_get(spark, d):
    return P.samples(spark, d).where("sample_id = 42").select("sample_id", "source", "content_hash")


@query("SELECT count(*) AS n FROM samples WHERE source = 'manual'", "samples")
def a23_count(spark, d):
    return P.samples(spark, d).where("source = 'manual'").agg(F.count("*").alias("n"))


@query(
    "WITH s AS (SELECT 'set' || (o_custkey % 20) AS name, o_orderkey, '{\"seed\": ' || o_custkey % 7 || ', \"split\": 0.2}' AS "
    "recipe FROM orders) SELECT name, o_orderkey AS version, CAST(json_extract(recipe, '$.seed') AS BIGINT) AS seed FROM (SELECT *, "
    "row_number() OVER (PARTITION BY name ORDER BY o_orderkey DESC) AS k FROM s) WHERE k = 1"
)
def d7_saved_datasets(spark, d):
    """The last dataset saved under each name, with its recipe parsed, in the order of the names (D7, D8)."""
    recipe = F.concat(F.lit('{"seed": '), (F.col("o_custkey") % 7).cast("string"), F.lit(', "split": 0.2}'))
    rows = P.read(spark, d, "orders").select(F.concat(F.lit("set"), (F.col("o_custkey") % 20).cast("string")).alias("name"), "o_orderkey", recipe.alias("recipe"))
    last = rows.groupBy("name").agg(F.max(F.struct("o_orderkey", "recipe")).alias("r"))
    return last.select("name", F.col("r.o_orderkey").alias("version"), F.from_json("r.recipe", "seed long, split double").alias("p")).select("name", "version", "p.seed").orderBy("name")


@query("""SELECT sample_id, '[{"action":"import","source":"' || source || '"},{"action":"exclude","source":"user"}]' AS provenance FROM samples""", "samples")
def f34_provenance(spark, d):
    """The history as a JSON array, one entry longer."""
    entry = "array<struct<action:string,source:string>>"
    start = F.to_json(F.array(F.struct(F.lit("import").alias("action"), F.col("source").alias("source"))))
    rows = P.samples(spark, d).select("sample_id", start.alias("history"))
    new = F.struct(F.lit("exclude").alias("action"), F.lit("user").alias("source"))
    return rows.select("sample_id", F.to_json(F.array_append(F.from_json("history", entry), new)).alias("provenance"))


# -- discovery and reports ------------------------------------------------------------------------

_FILES = "WITH f AS (SELECT 'videos/cam' || page_id % 7 || '-' || page_id || CASE page_id % 3 WHEN 0 THEN '.avi' WHEN 1 THEN '.mp4' ELSE '.txt' END AS path FROM pages)"


@query(_FILES +
    ", v AS (SELECT path, regexp_extract(path, '([^/]+)[.](avi|mp4)$', 1) AS stem, regexp_extract(path, '[.](avi|mp4)$', 1) AS kind "
    "FROM f WHERE path LIKE '%.avi' OR path LIKE '%.mp4') SELECT camera_id, path FROM (SELECT split_part(stem, '-', 1) AS camera_id, "
    "path, row_number() OVER (PARTITION BY split_part(stem, '-', 1) ORDER BY kind DESC, path DESC) AS k FROM v) WHERE k = 1"
)
def s1_camera_videos(spark, d):
    """A video a camera: the stem's part before the first dash names it, and of several the last one counts, by kind, then by name."""
    kind = F.when(F.col("page_id") % 3 == 0, ".avi").when(F.col("page_id") % 3 == 1, ".mp4").otherwise(".txt")
    files = P.read(spark, d, "pages").select(F.concat(F.lit("videos/cam"), (F.col("page_id") % 7).cast("string"), F.lit("-"), F.col("page_id").cast("string"), kind).alias("path"))
    parts = files.withColumns({"stem": F.regexp_extract("path", r"([^/]+)[.](avi|mp4)$", 1), "kind": F.regexp_extract("path", r"[.](avi|mp4)$", 1)}).where("kind <> ''")
    return parts.groupBy(F.split_part("stem", F.lit("-"), F.lit(1)).alias("camera_id")).agg(F.max_by("path", F.struct("kind", "path")).alias("path"))


@query(
    "WITH r AS (SELECT 'run_' || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey AS name FROM orders) SELECT max(name) AS "
    "latest, max(name) FILTER (name LIKE 'run_1995%') AS matched, count(*) AS n FROM r"
)
def t9_latest_run(spark, d):
    """The latest run by name, and the latest of those that a prefix names."""
    name = F.concat(F.lit("run_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.col("o_orderkey").cast("string"))
    rows = P.read(spark, d, "orders").select(name.alias("name"))
    return rows.agg(F.max("name").alias("latest"), F.max(F.when(F.startswith("name", F.lit("run_1995")), F.col("name"))).alias("matched"), F.count("*").alias("n"))


@query("SELECT run, printf('%.4f', max(metric) / 1e6) AS best, printf('%.4f', avg(metric) / 1e6) AS mean, count(*) AS epochs FROM runs GROUP BY run", "runs")
def s23_comparison_rows(spark, d):
    """Rows of the comparison file: metrics as strings of four decimals (S22, S23)."""
    rows = P.runs(spark, d).groupBy("run").agg(F.max("metric").alias("best"), F.avg("metric").alias("mean"), F.count("*").alias("epochs"))
    return rows.select("run", *[texts.fixed(F.col(c) / 1e6, 4).alias(c) for c in ("best", "mean")], "epochs")


@query(
    "SELECT o_orderkey, CAST(floor(o_totalprice / 60) AS BIGINT) || 'm ' || CAST(floor(o_totalprice) AS BIGINT) % 60 || 's' AS "
    "duration, CASE WHEN o_custkey % 3 = 0 THEN '-' ELSE CAST(floor(o_custkey % 101 / 100.0::DOUBLE * 100) AS BIGINT) || '% cons' || "
    "CASE WHEN o_custkey % 3 = 1 THEN ' / ' || CAST(floor(o_custkey % 53 / 100.0::DOUBLE * 100) AS BIGINT) || '% gap' ELSE '' END "
    "END AS sources, CASE WHEN o_totalprice < 60000 THEN '~' || CAST(floor(o_totalprice / 1000) AS BIGINT) || 's left' ELSE '~' || "
    "CAST(floor(o_totalprice / 60000) AS BIGINT) || 'm left' END AS eta FROM orders"
)
def f33_texts(spark, d):
    """Durations, shares of sources and times left as texts, all cut to whole numbers."""
    whole = lambda c: F.floor(c).cast("string")
    s, k = F.col("o_totalprice"), F.col("o_custkey")
    share = lambda m: whole(k % m / 100.0 * 100)
    sources = F.when(k % 3 == 0, "-").otherwise(F.concat(share(101), F.lit("% cons"), F.when(k % 3 == 1, F.concat(F.lit(" / "), share(53), F.lit("% gap"))).otherwise("")))
    eta = F.when(s < 60000, F.concat(F.lit("~"), whole(s / 1000), F.lit("s left"))).otherwise(F.concat(F.lit("~"), whole(s / 60000), F.lit("m left")))
    duration = F.concat(whole(s / 60), F.lit("m "), (F.floor(s) % 60).cast("string"), F.lit("s"))
    return P.read(spark, d, "orders").select("o_orderkey", duration.alias("duration"), sources.alias("sources"), eta.alias("eta"))


@query("""SELECT camera_id, '{"camera":"' || camera_id || '","n":' || count(*) || ',"tracks":' || count(DISTINCT track_id) || '}' AS report FROM obs GROUP BY camera_id""", "obs")
def s24_json_report(spark, d):
    per = P.observations(spark, d).groupBy("camera_id").agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("tracks"))
    return per.select("camera_id", F.to_json(F.struct(F.col("camera_id").alias("camera"), "n", "tracks")).alias("report"))


@query(
    ", m AS (SELECT run, max(metric) AS best, round(avg(metric), 6) AS mean, count(*) AS n FROM runs GROUP BY run) SELECT run, printf('%.2f', "
    "best) || CASE WHEN best = max(best) OVER () THEN ' *' ELSE '' END AS best, CAST(CAST(floor(mean) AS BIGINT) AS VARCHAR) || CASE "
    "WHEN mean = max(mean) OVER () THEN ' *' ELSE '' END AS mean FROM m", "runs")
def v3_comparison_table(spark, d):
    """Runs with the best value of each column marked."""
    rows = P.runs(spark, d).groupBy("run").agg(F.max("metric").alias("best"), F.round(F.avg("metric"), 6).alias("mean"))
    top = rows.agg(F.max("best").alias("top_best"), F.max("mean").alias("top_mean"))
    marked = lambda c: F.concat(F.format_string("%.2f", F.col(c)) if c == "best" else F.floor(c).cast("string"), F.when(F.col(c) == F.col(f"top_{c}"), " *").otherwise("")).alias(c)
    return rows.crossJoin(F.broadcast(top)).select("run", marked("best"), marked("mean"))  # one row


#: The metrics of the evaluation, each a query of one row, whose numbers are its report's lines.
_REPORT = {"tracking": "a4_tracking_metrics", "association": "a5_association_metrics", "detection": "a2_detection_metrics", "reconstruction": "a8_reconstruction_metrics"}
_LINES = {
    "tracking": ["n_tracks", "median_length", "coast_fraction", "coverage"],
    "association": ["observations", "singleton_rate", "yield"],
    "detection": ["total", "mean_jitter"],
    "reconstruction": ["mean_residual", "max_residual", "inlier_ratio"],
}


def c8_evaluation(spark, d):
    """All metrics as rows (stage, metric, value, line): a query for each stage that is there, and a line of the report for each (C8, V1)."""
    parts = []
    for stage, name in _REPORT.items():
        rows = QUERIES[name](spark, d).select(*[F.col(c).cast("double").alias(c) for c in _LINES[stage]])
        parts.append(rows.unpivot([], _LINES[stage], "metric", "value").withColumn("stage", F.lit(stage)))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.select("stage", "metric", F.round("value", 5).alias("value"), F.format_string("%s.%s: %.3f", "stage", "metric", "value").alias("line"))


QUERIES["c8_evaluation"] = c8_evaluation
ORACLE_SQL["c8_evaluation"] = " UNION ALL ".join(
    f"SELECT '{stage}' AS stage, '{m}' AS metric, round(CAST({m} AS DOUBLE), 5) AS value, printf('%s.%s: %.3f', '{stage}', '{m}', CAST({m} AS DOUBLE)) AS line FROM ({ORACLE_SQL[_REPORT[stage]]})" for stage, names in _LINES.items() for m in names
)


# -- lives of tracks ------------------------------------------------------------------------------

_HITS = (
    ", span AS (SELECT camera_id, track_id, min(frame_idx) AS f0, max(frame_idx) AS f1 FROM obs GROUP BY ALL), g AS (SELECT "
    "s.camera_id, s.track_id, f, f - f0 AS n, o.u, o.v FROM (SELECT *, unnest(range(f0, f1 + 1)) AS f FROM span) s LEFT JOIN (SELECT "
    "* FROM obs WHERE status = 'detected') o ON o.camera_id = s.camera_id AND o.track_id = s.track_id AND o.frame_idx = s.f)"
)
_DAMPED = "0.8::DOUBLE * coalesce(list_avg(w.d{a}), 0)"
_STEP = """SELECT g.camera_id, g.track_id, g.n, g.f,
CASE WHEN g.u IS NOT NULL THEN CASE WHEN w.st = 'coasting' OR w.hits + 1 >= 5 OR w.st = 'confirmed' THEN 'confirmed' ELSE 'probationary' END WHEN w.st = 'probationary' THEN CASE WHEN w.miss + 1 > 2 THEN 'dead' ELSE 'probationary' END WHEN w.miss + 1 > 7 THEN 'dead' ELSE 'coasting' END,
CASE WHEN g.u IS NOT NULL THEN w.hits + 1 ELSE 0 END, CASE WHEN g.u IS NOT NULL THEN 0 ELSE w.miss + 1 END,
CASE WHEN g.u IS NOT NULL THEN g.u ELSE w.x END, CASE WHEN g.u IS NOT NULL THEN g.v ELSE w.y END,
CASE WHEN g.u IS NOT NULL THEN NULL WHEN w.st = 'probationary' THEN NULL ELSE coalesce(w.px, w.x) + DX END, CASE WHEN g.u IS NOT NULL THEN NULL WHEN w.st = 'probationary' THEN NULL ELSE coalesce(w.py, w.y) + DY END,
CASE WHEN g.u IS NOT NULL AND w.x IS NOT NULL THEN list_slice(list_append(w.dx, g.u - w.x), -5, -1) ELSE w.dx END, CASE WHEN g.u IS NOT NULL AND w.x IS NOT NULL THEN list_slice(list_append(w.dy, g.v - w.y), -5, -1) ELSE w.dy END
FROM w JOIN g ON g.camera_id = w.camera_id AND g.track_id = w.track_id AND g.n = w.n + 1 WHERE w.st <> 'dead'""".replace("DX", _DAMPED.format(a="x")).replace("DY", _DAMPED.format(a="y"))


@query(
    _HITS +
        ", w AS (SELECT camera_id, track_id, n, f, 'probationary' AS st, CASE WHEN u IS NULL THEN 0 ELSE 1 END AS hits, CASE WHEN u "
        "IS NULL THEN 1 ELSE 0 END AS miss, u AS x, v AS y, CAST(NULL AS DOUBLE) AS px, CAST(NULL AS DOUBLE) AS py, CAST([] AS "
        "DOUBLE[]) AS dx, CAST([] AS DOUBLE[]) AS dy FROM g WHERE n = 0 UNION ALL "
     + _STEP +
        ") SELECT camera_id, track_id, f AS frame_idx, st AS state, round(coalesce(px, x), 5) AS u, round(coalesce(py, y), 5) AS v "
        "FROM w",
    "obs",
)
def g8_track_lives(spark, d):
    return lifecycle.lives(P.observations(spark, d)).select("camera_id", "track_id", "frame_idx", "state", F.round("u", 5).alias("u"), F.round("v", 5).alias("v"))


ORACLE_SQL["g8_track_lives"] = ORACLE_SQL["g8_track_lives"].replace("WITH ", "WITH RECURSIVE ", 1)
