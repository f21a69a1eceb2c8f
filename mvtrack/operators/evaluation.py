"""Evaluation: midline sets, metrics of midlines and reconstructions, uncertainty, lookup tables, orientation votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .orientation import carried
from .tables import rig


def midline_sets(own: DataFrame, groups: DataFrame, midlines: DataFrame, spine: DataFrame, tolerance: float, period: int) -> DataFrame:
    """(frame_idx, fish_id, camera_id, track_id, det_idx): a midline for each fish and camera of the spine's frames.

    The nearest detection is chosen first, and only then dropped if it has no
    midline; of several tracks of a fish in a camera the last counts.  Frames
    with nothing have one row without a fish.
    """
    seen = own.join(F.broadcast(spine), "frame_idx", "left_semi").join(groups, ["camera_id", "track_id"])
    boxes = midlines.select(F.col("frame_idx").alias("f"), F.col("camera_id").alias("c"), "det_idx", "has_midline", (F.col("x") + F.col("w") / 2).alias("bx"), (F.col("y") + F.col("h") / 2).alias("by"))
    met = seen.join(boxes, (F.col("frame_idx") % period == F.col("f")) & (F.col("camera_id") == F.col("c")))
    dist = F.sqrt((F.col("px") - F.col("bx")) ** 2 + (F.col("py") - F.col("by")) ** 2)
    best = met.withColumn("dist", dist).where(F.col("dist") <= tolerance).groupBy("frame_idx", "camera_id", "track_id", "fish_id").agg(F.min(F.struct("dist", (-F.col("det_idx")).alias("last"), "has_midline")).alias("b"))
    one = best.where("b.has_midline").groupBy("frame_idx", "fish_id", "camera_id").agg(F.max(F.struct("track_id", (-F.col("b.last")).alias("det_idx"))).alias("m"))
    return spine.join(one, "frame_idx", "left").select("frame_idx", "fish_id", "camera_id", "m.track_id", "m.det_idx")


def midline_metrics(midlines: DataFrame, centroids: DataFrame, least: float) -> DataFrame:
    """Mean and spread of the points' confidences, the share above ``least``, and the mean step of the fish's centroids."""
    sure = F.expr("transform(sequence(1, n), i -> 1D)")
    conf = midlines.select(F.explode(F.coalesce("confidences", sure)).alias("conf"))
    per = conf.agg(F.round(F.avg("conf"), 6).alias("mean_confidence"), F.round(F.stddev_pop("conf"), 6).alias("std_confidence"), F.round(F.avg((F.col("conf") > least).cast("int")), 6).alias("completeness"))
    w = Window.partitionBy("fish_id").orderBy("frame_idx")
    at = centroids.groupBy("fish_id", "frame_idx").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    steps = at.withColumn("step", step).groupBy("fish_id").agg(F.coalesce(F.avg("step"), F.lit(0.0)).alias("step"))
    return per.crossJoin(F.broadcast(steps.agg(F.round(F.avg("step"), 6).alias("smoothness"))))  # a row each


def reconstruction_metrics(rows: DataFrame) -> DataFrame:
    """Residuals, the share of low confidence, the ratio of inliers (1.0 where there is nothing), the largest displacement."""
    low = F.avg(F.col("is_low").cast("int"))
    return rows.agg(
        F.round(F.avg("residual"), 6).alias("mean_residual"),
        F.max("residual").alias("max_residual"),
        F.round(low, 6).alias("low_confidence_rate"),
        F.round(1 - F.coalesce(low, F.lit(0.0)), 6).alias("inlier_ratio"),
        F.round(F.max("displacement"), 6).alias("max_displacement"),
    )


def z_denoising(profiles: DataFrame) -> DataFrame:
    """(fish_id, z_range, rms, snr) of profiles (fish_id, frame_idx, i, z).

    The median over frames of the range along the body; the mean over frames of
    the root mean square of the change since the frame before; the spread of the
    mean profile over that of the changes, 0 where nothing changes.
    """
    change = profiles.withColumn("dz", F.col("z") - F.lag("z").over(Window.partitionBy("fish_id", "i").orderBy("frame_idx")))
    frames = change.groupBy("fish_id", "frame_idx").agg((F.max("z") - F.min("z")).alias("g"), F.sqrt(F.avg(F.col("dz") ** 2)).alias("rms"))
    per = frames.groupBy("fish_id").agg(F.expr("percentile(g, 0.5)").alias("z_range"), F.avg("rms").alias("rms"))
    spread = change.groupBy("fish_id", "i").agg(F.avg("z").alias("m"), F.count("dz").alias("n"), F.sum("dz").alias("s"), F.sum(F.col("dz") ** 2).alias("q")).groupBy("fish_id")
    mean = F.sum("s") / F.sum("n")
    noise = spread.agg(F.stddev_pop("m").alias("signal"), F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / F.sum("n") - mean * mean)).alias("noise"))
    snr = F.when(F.col("noise") > 1e-12, F.col("signal") / F.col("noise")).otherwise(0.0)
    return per.join(noise, "fish_id").select("fish_id", "z_range", "rms", snr.alias("snr"))


def centroid_reprojection(seen: DataFrame, camera: dict[str, float], centre: G.Vec) -> DataFrame:
    """Residuals of the consensus of two sightings or more in each camera, over all, by camera and by fish."""
    mean = seen.groupBy("fish_id", "frame_idx").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n")).where("n >= 2").drop("n")
    rows = seen.join(mean, ["fish_id", "frame_idx"]).withColumns({"px": F.col("cx") + 0.01, "py": F.col("cy") + 0.01, "pz": F.lit(1.0)})
    u, v = G.project(G.vec("px", "py", "pz"), centre=centre, **camera)
    apart = F.sqrt((u - camera["cx"] - camera["fx"] * F.col("x")) ** 2 + (v - camera["cy"] - camera["fx"] * F.col("y")) ** 2)
    rows = rows.select("camera_id", "fish_id", "frame_idx", apart.alias("residual"))
    # Frames are counted through one row a group and frame: sets and a distinct count in one aggregation would multiply the rows by both.
    per = rows.groupingSets([["frame_idx"], ["frame_idx", "camera_id"], ["frame_idx", "fish_id"]], "frame_idx", "camera_id", "fish_id").agg(F.sum("residual").alias("s"), F.count("*").alias("n"), F.max("residual").alias("m"), F.grouping_id().alias("g"))
    out = per.groupBy("g", "camera_id", "fish_id").agg(F.round(F.sum("s") / F.sum("n"), 5).alias("mean_residual"), F.round(F.max("m"), 5).alias("max_residual"), F.count("*").alias("frames"))
    return out.drop("g")


def uncertainty(points: DataFrame, cameras: DataFrame, water_z: float, noise: float = 0.5) -> DataFrame:
    """(k, cameras, xy_error, z_error) of points (k, x, y, z): how far each moves where pixels are off, one way after the other.

    Every second of the cameras (camera_id, n, fx, ...), by their numbers n, moves
    the opposite way.  Cameras are few by nature, and sent to where the points
    are; a point that fewer than two see has no row.
    """
    lens = {"fx": F.col("fx"), "fy": F.col("fy"), "cx": F.col("cx"), "cy": F.col("cy"), "centre": G.vec("px", "py", "pz"), "water_z": water_z}
    u, v = G.project(G.vec("x", "y", "z"), **lens)
    rows = points.crossJoin(rig(cameras)).withColumns({"u": u, "v": v}).where("u >= 0 AND u < width AND v >= 0 AND v < height")
    sign = F.when(F.col("n") % 2 == 0, noise).otherwise(-noise)
    ways = [F.struct(F.lit(s).alias("s"), F.lit(a).alias("du"), F.lit(b).alias("dv")) for s, (a, b) in enumerate([(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)])]
    rows = rows.withColumn("way", F.explode(F.array(*ways)))
    o, b = G.refract((F.col("u") + sign * F.col("way.du"), F.col("v") + sign * F.col("way.dv")), **lens)
    rays = rows.select("k", "x", "y", "z", F.col("way.s").alias("s"), *[c.alias(n) for n, c in zip(("ox", "oy", "oz", "dx", "dy", "dz"), (*o, *b), strict=True)])
    sums = rays.groupBy("k", "x", "y", "z", "s").agg(*G.triangulation_sums(G.vec("ox", "oy", "oz"), G.vec("dx", "dy", "dz"), F.lit(1.0)), F.count("*").alias("cams")).where("cams >= 2")
    px, py, pz = G.triangulated()
    off = sums.select("k", "cams", F.sqrt((px - F.col("x")) ** 2 + (py - F.col("y")) ** 2).alias("xy"), F.abs(pz - F.col("z")).alias("dz"))
    return off.groupBy("k").agg(F.max("cams").alias("cameras"), F.round(F.avg("xy"), 6).alias("xy_error"), F.round(F.avg("dz"), 6).alias("z_error"))


def forward_table(spark: SparkSession, camera: dict[str, float], width: int, height: int, step: int) -> DataFrame:
    """(gx, gy, ox, oy, dx, dy, dz): the ray of each pixel of a grid."""
    nx, ny = width // step + 1, height // step + 1
    grid = spark.range(nx * ny).select((F.col("id") % nx).alias("gx"), F.expr(f"id div {nx}").alias("gy"))
    o, b = G.refract((F.col("gx") * step, F.col("gy") * step), camera["fx"], camera["cx"], camera["cy"], (F.lit(0.0),) * 3, camera["water_z"])
    return grid.select("gx", "gy", *[c.alias(n) for n, c in zip(("ox", "oy", "dx", "dy", "dz"), (o[0], o[1], *b), strict=True)])


def table_cast(rows: DataFrame, table: DataFrame, step: int, cells_x: int, cells_y: int) -> DataFrame:
    """``rows`` with the direction (dx, dy, dz) of their pixel (x, y), between the table's four corners; unit length.

    Cells are clamped to the table; what lies outside goes on along the outer cell.
    """
    gx = F.greatest(F.lit(0), F.least(F.lit(cells_x - 1), F.floor(F.col("x") / step)))
    gy = F.greatest(F.lit(0), F.least(F.lit(cells_y - 1), F.floor(F.col("y") / step)))
    out = rows.withColumns({"__gx": gx, "__gy": gy})
    for i in (0, 1):
        for j in (0, 1):
            corner = table.select((F.col("gx") - i).alias("__gx"), (F.col("gy") - j).alias("__gy"), F.struct("dx", "dy", "dz").alias(f"__c{i}{j}"))
            out = out.join(F.broadcast(corner), ["__gx", "__gy"])
    fx, fy = F.col("x") / step - F.col("__gx"), F.col("y") / step - F.col("__gy")
    share = {(i, j): (fx if i else 1 - fx) * (fy if j else 1 - fy) for i in (0, 1) for j in (0, 1)}

    def between(c: str) -> Column:
        terms = [w * F.col(f"__c{i}{j}.{c}") for (i, j), w in share.items()]
        return sum(terms[1:], terms[0])

    out = out.withColumns({f"__{c}": between(c) for c in ("dx", "dy", "dz")})
    size = G.norm(G.vec("__dx", "__dy", "__dz"))
    return out.withColumns({c: F.col(f"__{c}") / size for c in ("dx", "dy", "dz")}).drop("__gx", "__gy", "__c00", "__c01", "__c10", "__c11", "__dx", "__dy", "__dz")


def votes(midlines: DataFrame) -> DataFrame:
    """(vec_id, fish_id, frame_idx, geometric, velocity): whether each midline's order is taken for head first.

    Without a step, or a direction of its own, a midline has no vote by velocity;
    one at right angles to the step counts as against.
    """
    at = midlines.select("vec_id", F.col("label").alias("fish_id"), F.col("vec_id").alias("frame_idx"), F.expr("points[0].x - points[31].x").alias("hx"), F.expr("points[0].y - points[31].y").alias("hy"), F.expr("aggregate(points, 0D, (s, p) -> s + p.x) / size(points)").alias("cx"), F.expr("aggregate(points, 0D, (s, p) -> s + p.y) / size(points)").alias("cy"), F.expr("points[3].x").alias("g"))
    w = Window.partitionBy("fish_id").orderBy("frame_idx")
    v = at.withColumns({"vx": F.col("cx") - F.lag("cx").over(w), "vy": F.col("cy") - F.lag("cy").over(w)})
    geometric = F.when(F.col("g") > 0, 1).otherwise(-1)
    velocity = F.expr("CASE WHEN vx IS NULL OR sqrt(vx * vx + vy * vy) < 0.01 OR sqrt(hx * hx + hy * hy) < 1e-9 THEN 0 WHEN hx * vx + hy * vy > 0 THEN 1 ELSE -1 END")
    return v.select("vec_id", "fish_id", "frame_idx", geometric.alias("geometric"), velocity.alias("velocity"))


def orientations(votes_: DataFrame, geometric: float = 0.5, velocity: float = 0.3, before: float = 0.4) -> DataFrame:
    """(vec_id, orientation): each by its weighted votes and the orientation before it, from 0; ties are head first."""
    w = Window.partitionBy("fish_id").orderBy("frame_idx", "vec_id")
    votes = geometric * F.col("geometric") + velocity * F.col("velocity")
    return votes_.select("vec_id", carried(votes, before, w).alias("orientation"))


def geometric_votes(heads: DataFrame, tails: DataFrame, key: str) -> DataFrame:
    """(key, error, vote) by rays (key, ray_id, o, d) of the heads and of the tails of a group's midlines, one a camera.

    The error is the mean distance of two head rays and that of two tail rays;
    against it stands that of all midlines turned round, and the smaller one wins,
    the given order on ties.  Turning all of them only swaps heads and tails, so the vote
    is 1, as surveyed, and 0 with fewer than two cameras.  Groups are bounded by
    the cameras.
    """
    names = ["ray_id", "ox", "oy", "oz", "dx", "dy", "dz"]

    def spread(rays: DataFrame, name: str) -> DataFrame:
        a, b = (rays.select(key, *[F.col(c).alias(f"{c}_{s}") for c in names]) for s in "ab")
        dist, _ = G.closest_approach(*[G.vec(*[f"{n}{x}_{s}" for x in "xyz"]) for s in "ab" for n in "od"])
        return a.join(b, key).where("ray_id_a < ray_id_b").groupBy(key).agg(F.avg(dist).alias(name))

    all_ = heads.select(key).union(tails.select(key)).distinct()
    both = all_.join(spread(heads, "head"), key, "left").join(spread(tails, "tail"), key, "left")
    vote = F.expr("CASE WHEN head IS NULL OR tail IS NULL THEN 0 WHEN head + tail <= tail + head THEN 1 ELSE -1 END")
    return both.select(key, F.coalesce(F.col("head") + F.col("tail"), F.lit(0.0)).alias("error"), vote.alias("vote"))
