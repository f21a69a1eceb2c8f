"""Canonical tables as projections of relational ones.

Each has the same columns as the real input would, so operators don't know the
difference.  ``SQL`` says the same for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracklet observations: (camera_id, track_id, frame_idx, u, v, status), one a track and frame."""
    frame = F.expr("cast(timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts) as bigint)")
    status = F.when(F.col("event_type") == "error", "coasted").when(F.col("event_type") == "signup", "interpolated").otherwise("detected")
    rows = read(spark, sf_dir, "events").select(
        F.concat(F.lit("cam_"), (F.col("user_id") % 5).cast("string")).alias("camera_id"), F.col("user_id").alias("track_id"), frame.alias("frame_idx"), F.col("value").alias("u"), (F.col("event_id") % 997).cast("double").alias("v"), status.alias("status"), "ts", "event_id"
    )
    first = Window.partitionBy("track_id", "frame_idx").orderBy("ts", "event_id")
    return rows.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn", "ts", "event_id")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_idx, camera_id, det_idx, confidence, x, y, w, h): boxes of each frame and camera, numbered from 0."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("frame_idx"), F.concat(F.lit("cam_"), (F.col("l_suppkey") % 8).cast("string")).alias("camera_id"), "l_discount", "l_quantity", *order)
    number = F.row_number().over(Window.partitionBy("frame_idx", "camera_id").orderBy(*order)) - 1
    # What follows from other columns is made after the numbers, so that it isn't shuffled with them.
    return rows.withColumn("det_idx", number.cast("bigint")).select(
        "frame_idx",
        "camera_id",
        (1 - F.col("l_discount")).alias("confidence"),
        (F.col("l_partkey") % 1600).cast("double").alias("x"),
        (F.col("l_partkey") * 7 % 1200).cast("double").alias("y"),
        F.col("l_quantity").alias("w"),
        (F.col("l_quantity") / 2).alias("h"),
        "det_idx",
    )


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ray_id, camera_id, ox, oy, oz, dx, dy, dz); directions are not unit vectors."""
    dims = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("ox", "oy", "oz", "dx", "dy", "dz"))]
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ray_id"), F.col("label").alias("camera_id"), *dims)


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, points): 32 points of each embedding, as an array of (x, y)."""
    points = "transform(sequence(0, 31), i -> struct(cast(embedding[2 * i] as double) AS x, cast(embedding[2 * i + 1] as double) AS y))"
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.expr(points).alias("points"))


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(camera_id, c, fx, fy, cx, cy, px, py, pz, width, height): a rig of cameras that look straight down, one a nation."""
    c = F.col("n_nationkey").cast("bigint")
    focal = (1400 + 10 * (c % 5)).cast("double")
    place = {"px": (c % 5) * 0.3 - 0.6, "py": F.expr("n_nationkey div 5") * 0.3 - 0.6, "pz": F.lit(0.0)}
    lens = {"fx": focal, "fy": focal, "cx": F.lit(800.0), "cy": F.lit(600.0)}
    numbers = [v.cast("double").alias(k) for k, v in {**lens, **place}.items()]
    return read(spark, sf_dir, "nation").select(F.concat(F.lit("cam_"), c.cast("string")).alias("camera_id"), c.alias("c"), *numbers, F.lit(1600).alias("width"), F.lit(1200).alias("height"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-store samples: (sample_id, content_hash, source, priority, tags, confidence, parent_id, created)."""
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    priority = F.col("doc_id") % 3
    rows = read(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    tags = F.filter(F.array(F.col("lang"), F.when(F.col("toxic") == 1, F.lit("excluded"))), lambda t: t.isNotNull())
    return rows.select(
        F.col("doc_id").alias("sample_id"),
        F.sha2("text", 256).alias("content_hash"),
        F.when(priority == 0, "pseudo").when(priority == 1, "corrected").otherwise("manual").alias("source"),
        priority.alias("priority"),
        tags.alias("tags"),
        F.col("quality").cast("double").alias("confidence"),
        F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") - 1).alias("parent_id"),
        F.col("doc_id").alias("created"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training runs: (run, epoch, metric)."""
    epoch = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), epoch.cast("bigint").alias("epoch"), F.col("o_totalprice").alias("metric"))


SQL = {
    "obs": """obs AS (SELECT camera_id, track_id, frame_idx, u, v, status FROM (SELECT 'cam_' || (user_id % 5) AS camera_id, user_id AS track_id, date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS frame_idx, value AS u, CAST(event_id % 997 AS DOUBLE) AS v, CASE event_type WHEN 'error' THEN 'coasted' WHEN 'signup' THEN 'interpolated' ELSE 'detected' END AS status, row_number() OVER (PARTITION BY user_id, date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1)""",
    "det": """det AS (SELECT l_orderkey % 500 AS frame_idx, 'cam_' || (l_suppkey % 8) AS camera_id, 1 - l_discount AS confidence, CAST(l_partkey % 1600 AS DOUBLE) AS x, CAST(l_partkey * 7 % 1200 AS DOUBLE) AS y, l_quantity AS w, l_quantity / 2 AS h, row_number() OVER (PARTITION BY l_orderkey % 500, l_suppkey % 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS det_idx FROM lineitem)""",
    "rays": """rays AS (SELECT vec_id AS ray_id, label AS camera_id, CAST(embedding[1] AS DOUBLE) AS ox, CAST(embedding[2] AS DOUBLE) AS oy, CAST(embedding[3] AS DOUBLE) AS oz, CAST(embedding[4] AS DOUBLE) AS dx, CAST(embedding[5] AS DOUBLE) AS dy, CAST(embedding[6] AS DOUBLE) AS dz FROM embeddings)""",
    "pts": """pts AS (SELECT vec_id, label, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, (SELECT unnest(range(32)) AS i))""",
    "cams": """cams AS (SELECT 'cam_' || n_nationkey AS camera_id, n_nationkey AS c, CAST(1400 + 10 * (n_nationkey % 5) AS DOUBLE) AS fx, 800::DOUBLE AS cx, 600::DOUBLE AS cy, (n_nationkey % 5) * 0.3::DOUBLE - 0.6::DOUBLE AS px, (n_nationkey // 5) * 0.3::DOUBLE - 0.6::DOUBLE AS py FROM nation)""",
    "samples": """samples AS (SELECT doc_id AS sample_id, sha256(text) AS content_hash, CASE doc_id % 3 WHEN 0 THEN 'pseudo' WHEN 1 THEN 'corrected' ELSE 'manual' END AS source, doc_id % 3 AS priority, lang, coalesce(toxic, 0) = 1 AS excluded, CAST(quality AS DOUBLE) AS confidence, CASE WHEN doc_id % 7 = 0 THEN doc_id - 1 END AS parent_id, doc_id AS created FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id))""",
    "runs": """runs AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS epoch, o_totalprice AS metric FROM orders)""",
}
