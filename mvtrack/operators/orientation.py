"""Which end of a midline is the head: votes by cameras, movement and the frame before, and midlines turned accordingly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FISH, FRAME = ["fish_id"], ["fish_id", "frame_idx"]


def carried(votes: Column, before: Column | float, window) -> Column:
    """1 or -1 by the sum of a row's ``votes`` and ``before`` times the row before it, from 0; 1 on ties.

    What comes out is the same whatever came before, or it is what came before: so
    a row has the value of the last one that stands by itself, which a running
    window finds without holding a group.
    """
    first = F.row_number().over(window) == 1
    sign = lambda c: F.when(c >= 0, 1).otherwise(-1)
    alone = F.when(first, sign(votes)).when(sign(votes + before) == sign(votes - before), sign(votes))
    return F.last(alone, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def matched(tracks: DataFrame, midlines: DataFrame, within: float) -> DataFrame:
    """(fish_id, frame_idx, camera_id, det_idx, points): the midline of each camera of each fish.

    A track's row takes the nearest detection of its frame and camera nearer than
    ``within`` pixels, the first on ties; one without a midline (``points`` null)
    gives none.  Of a camera's several tracks the last counts that has one.
    """
    near = midlines.select("frame_idx", "camera_id", "det_idx", F.col("u").alias("mu"), F.col("v").alias("mv"), "points")
    far = F.sqrt((F.col("u") - F.col("mu")) ** 2 + (F.col("v") - F.col("mv")) ** 2)
    met = tracks.select(*FRAME, "camera_id", "track_id", "u", "v").join(near, ["frame_idx", "camera_id"]).withColumn("far", far).where(F.col("far") < within)
    best = met.groupBy(*FRAME, "camera_id", "track_id").agg(F.min_by(F.struct("det_idx", "points"), F.struct("far", "det_idx")).alias("d")).where("d.points IS NOT NULL")
    return best.groupBy(*FRAME, "camera_id").agg(F.max_by("d", "track_id").alias("d")).select(*FRAME, "camera_id", "d.det_idx", "d.points")


def oriented(tracks: DataFrame, midlines: DataFrame, within: float = 10.0, least_speed: float = 2.0, geometric: float = 1.0, velocity: float = 0.5, before: float = 0.3) -> DataFrame:
    """(fish_id, frame_idx, camera_id, det_idx, orientation, points) with the head first, by all cameras of a frame together.

    ``tracks`` has (fish_id, camera_id, track_id, frame_idx, u, v), ``midlines``
    (frame_idx, camera_id, det_idx, u, v, points) with points null or an array of
    (u, v, ...).  Three votes are added up with the frame before, which counts
    ``before``: cameras agree, ``geometric``, if there are two (turning all midlines
    round changes no distance between heads or between tails, so the rays never
    vote against); and ``velocity`` for or against, as the head of the first
    camera's midline points along or against the movement of the first track that
    goes on in a camera with detections, unless it is slower than ``least_speed``.
    Ties stay as they are.  Frames of a fish without a midline are passed over.
    """
    own = matched(tracks, midlines, within)
    frames = own.groupBy(*FRAME).agg(F.count("*").alias("cameras"), F.min_by("points", "camera_id").alias("p"))
    way = {a: F.col("p")[0][a] - F.element_at("p", -1)[a] for a in "uv"}
    frames = frames.select(*FRAME, "cameras", *[c.alias(f"h{a}") for a, c in way.items()])
    one = Window.partitionBy("fish_id", "camera_id", "track_id").orderBy("frame_idx")
    steps = tracks.withColumns({f"d{a}": F.col(a) - F.lag(a).over(one) for a in "uv"}).where("du IS NOT NULL AND dv IS NOT NULL")
    there = midlines.select("frame_idx", "camera_id").distinct()
    moves = steps.join(there, ["frame_idx", "camera_id"], "left_semi").groupBy(*FRAME).agg(F.min_by(F.struct("du", "dv"), F.struct("camera_id", "track_id")).alias("m")).select(*FRAME, "m.*")
    along = F.expr(
        f"CASE WHEN du IS NULL OR sqrt(du * du + dv * dv) < {max(least_speed, 1e-6)}D OR sqrt(hu * hu + hv * hv) < 1e-6 THEN 0D WHEN hu * du + hv * dv > 0 THEN 1D ELSE -1D END")
    votes = F.when(F.col("cameras") >= 2, geometric).otherwise(0.0) + velocity * along
    signs = frames.join(moves, FRAME, "left").withColumn("votes", votes)
    signs = signs.withColumn("orientation", carried(F.col("votes"), before, Window.partitionBy("fish_id").orderBy("frame_idx"))).select(*FRAME, "orientation")
    turned = F.when(F.col("orientation") == 1, F.col("points")).otherwise(F.reverse("points"))
    return own.join(signs, FRAME).select(*FRAME, "camera_id", "det_idx", "orientation", turned.alias("points"))
