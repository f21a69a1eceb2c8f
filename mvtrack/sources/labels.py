"""Readers and writers of annotation files, as DataFrame jobs.

A label line is ``class cx cy w h`` and then ``x y v`` for each keypoint, all
relative to the image; an annotation document has arrays of images and of
annotations whose keypoints are flat triples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import numbered

_KEYPOINTS = "array<double>"
COCO = f"images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<id:long,image_id:long,category_id:int,bbox:{_KEYPOINTS},keypoints:{_KEYPOINTS},num_keypoints:int>>"


def read_pose_labels(spark: SparkSession, path: str, n_keypoints: int) -> DataFrame:
    """(stem, line_no, class_id, box, points): one row a line; lines that are too short are left out."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1).alias("stem"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    parts = files.withColumn("p", F.transform(F.filter(F.split(F.trim("line"), r"\s+"), lambda s: s != ""), lambda s: s.try_cast("double"))).where(F.size("p") >= 5 + 3 * n_keypoints)
    points = f"transform(sequence(0, {n_keypoints - 1}), i -> struct(p[5 + 3 * i] AS x, p[6 + 3 * i] AS y, p[7 + 3 * i] > 0 AS visible))"
    return parts.select("stem", "line_no", F.col("p")[0].cast("int").alias("class_id"), F.slice("p", 2, 4).alias("box"), F.expr(points).alias("points"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, file_name, width, height, annotation_id, keypoints): images without annotations have a null one."""
    docs = spark.read.json(path, schema=COCO, multiLine=True)
    images = docs.select(F.inline("images")).withColumnRenamed("id", "image_id")
    notes = docs.select(F.inline("annotations")).select("image_id", F.col("id").alias("annotation_id"), "keypoints")
    return images.join(notes, "image_id", "left")


def to_annotations(labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Label rows and (stem, width, height) as annotation rows with ids in file order; points that aren't visible are zero triples."""
    images = numbered(sizes, "image_id", "stem").withColumn("image_id", F.col("image_id") + 1)
    rows = labels.join(images, "stem")
    flat = F.flatten(F.transform("points", lambda p: F.when(p["visible"], F.array(p["x"] * F.col("width"), p["y"] * F.col("height"), F.lit(2.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))))
    made = rows.select("image_id", "stem", "width", "height", "line_no", flat.alias("keypoints"))
    out = numbered(made, "annotation_id", "image_id", "line_no").withColumn("annotation_id", F.col("annotation_id") + 1)
    return out.select("image_id", "stem", "width", "height", "annotation_id", "keypoints")


def to_label_lines(annotations: DataFrame, class_id: int = 0) -> DataFrame:
    """(stem, line): normalised to 6 places; the box is that of the visible points."""
    n = "cast(size(keypoints) / 3 as int)"
    points = F.expr(f"transform(sequence(0, {n} - 1), i -> struct(keypoints[3 * i] / width AS x, keypoints[3 * i + 1] / height AS y, keypoints[3 * i + 2] AS v))")
    rows = annotations.where("keypoints IS NOT NULL").withColumn("p", points)
    seen = rows.withColumn("s", F.filter("p", lambda p: p["v"] > 0)).where("size(s) > 0")
    low = {a: F.expr(f"array_min(transform(s, q -> q.{a}))") for a in "xy"}
    high = {a: F.expr(f"array_max(transform(s, q -> q.{a}))") for a in "xy"}
    six = lambda c: F.format_string("%.6f", c)
    box = [six((low[a] + high[a]) / 2) for a in "xy"] + [six(high[a] - low[a]) for a in "xy"]
    triples = F.flatten(F.transform("p", lambda p: F.when(p["v"] > 0, F.array(six(p["x"]), six(p["y"]), F.lit("2"))).otherwise(F.array(six(F.lit(0.0)), six(F.lit(0.0)), F.lit("0")))))
    return seen.select("stem", F.concat_ws(" ", F.lit(str(class_id)), *box, triples).alias("line"))
