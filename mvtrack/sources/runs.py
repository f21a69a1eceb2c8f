"""Readers and writers of run folders: calibrations, lookup tables, chunks with a manifest, summaries and metric files."""

from __future__ import annotations

import hashlib
import re
import warnings
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import texts

_ROWS = "array<array<double>>"
CALIBRATION = f"cameras map<string,struct<K:{_ROWS},R:{_ROWS},t:array<double>,width:int,height:int>>, water_z double, n_air double, n_water double"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """A row a camera: (camera_id, fx, fy, cx, cy, rotation, t, x, y, z, width, height, water_z, n_air, n_water); x, y, z is where it stands."""
    doc = spark.read.json(path, schema=CALIBRATION, multiLine=True)
    rows = doc.select("water_z", F.coalesce("n_air", F.lit(1.0)).alias("n_air"), F.coalesce("n_water", F.lit(1.333)).alias("n_water"), F.explode("cameras").alias("camera_id", "c"))
    place = [-sum((F.col("c.R")[k][i] * F.col("c.t")[k] for k in range(1, 3)), F.col("c.R")[0][i] * F.col("c.t")[0]) for i in range(3)]
    k = F.col("c.K")
    return rows.select("camera_id", k[0][0].alias("fx"), k[1][1].alias("fy"), k[0][2].alias("cx"), k[1][2].alias("cy"), F.col("c.R").alias("rotation"), "c.t", *[p.alias(n) for n, p in zip("xyz", place, strict=True)], "c.width", "c.height", "water_z", "n_air", "n_water")


def save_table(table: DataFrame, path: str, config_hash: str) -> None:
    """A lookup table with the hash of the configuration that it was made with."""
    table.withColumn("config_hash", F.lit(config_hash)).write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str, config_hash: str) -> DataFrame | None:
    """The table, or None where there is none or any of it was made with another configuration."""
    if not _exists(spark, path):
        return None
    table = spark.read.parquet(path)
    if not table.where(~F.col("config_hash").eqNullSafe(F.lit(config_hash))).isEmpty():
        return None
    return table.drop("config_hash")


class StaleCache(ValueError):
    """A cache that was written by other code, or is not whole."""


def fingerprint(schema: T.StructType) -> str:
    """Twelve digits that change with the names or types of the columns."""
    return hashlib.sha256(";".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(schema, key=lambda f: f.name)).encode()).hexdigest()[:12]


def write_cache(rows: DataFrame, path: str, frames: int) -> None:
    """A stage's rows, with the number of its frames and the fingerprint of its columns beside them."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    note = rows.sparkSession.createDataFrame([(frames, fingerprint(rows.schema))], "frames long, fingerprint string")
    note.coalesce(1).write.mode("overwrite").json(f"{path}/note")


def read_cache(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A stage's rows, whose columns must have those of ``schema``, and whose frames must be as many as were written.

    With ``strict`` another fingerprint is an error too; else it is a warning, and
    columns beyond the schema are read as they are.
    """
    want = T._parse_datatype_string(schema)
    rows = spark.read.parquet(f"{path}/rows")
    lacking = [f"{f.name} {f.dataType.simpleString()}" for f in want if f.name not in rows.columns or rows.schema[f.name].dataType != f.dataType]
    if lacking:
        raise StaleCache(f"{path} lacks {', '.join(lacking)}; write it again")
    note = spark.read.json(f"{path}/note", schema="frames long, fingerprint string").first()
    if note is None:
        raise StaleCache(f"{path} has no note of its frames")
    if note.fingerprint != fingerprint(want):
        if strict:
            raise StaleCache(f"{path} has the fingerprint {note.fingerprint}, not {fingerprint(want)}")
        warnings.warn(f"{path} has another fingerprint: {note.fingerprint}", stacklevel=2)
    return check_frames(rows, note.frames)


class Chunk(NamedTuple):
    index: int
    path: str
    start: int | None


def _chunks(spark: SparkSession, path: str) -> list[Chunk]:
    """The chunks of a run that the manifest lists, or, without one, its folders ``chunk_N``; a row a chunk."""
    if _exists(spark, f"{path}/manifest.json"):
        listed = spark.read.json(f"{path}/manifest.json", multiLine=True, schema="chunks array<struct<index:int,path:string,start:long>>")
        return sorted((Chunk(*c) for c in listed.select(F.inline("chunks")).collect()), key=lambda c: c.index)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/chunk_*")
    names = [f.getPath().getName() for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)]
    numbered = [(re.fullmatch(r"chunk_(\d+)", n), n) for n in names]
    return sorted((Chunk(int(m[1]) if m else 0, n, None) for m, n in numbered), key=lambda c: (c.index, c.path))


def read_run(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame | None:
    """All chunks of a run, with frames counted on by each chunk's start, read as one table.

    The manifest lists (index, path, start); chunks that are not there are left
    out with a warning.  Without a manifest the folders ``chunk_N`` are taken by
    their number.  A chunk without a start goes on after the last frame of the one
    before it, and a lone one stays as it is.  Columns that a chunk lacks are null.
    None without a chunk.  With ``tolerant`` files that can't be read are left out
    too, with a warning for each chunk of which nothing could be.
    """
    chunks = _chunks(spark, path)
    there = [c for c in chunks if _exists(spark, f"{path}/{c.path}")]
    for c in chunks:
        if c not in there:
            warnings.warn(f"chunk {c.index} is missing", stacklevel=2)
    if not there:
        return None
    read = spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", str(tolerant).lower())
    rows = read.parquet(*[f"{path}/{c.path}" for c in there]).withColumn("__path", F.col("_metadata.file_path"))
    # A file's folder below the run tells its chunk.
    depth = {c.path.strip("/").count("/") + 1 for c in there}
    if len(depth) > 1:
        raise ValueError("the manifest's paths are of several depths")
    own = F.array_join(F.slice(F.reverse(F.split("__path", "/")), 2, depth.pop()), "/")
    rows = rows.withColumn("__own", F.array_join(F.reverse(F.split(own, "/")), "/"))
    there = [c._replace(path=c.path.strip("/")) for c in there]
    if any(c.start is None for c in there):
        frames = {r["__own"]: r.n for r in rows.groupBy("__own").agg((F.max("frame_idx") + 1).alias("n")).collect()}  # a row a chunk
        start, dated = 0, []
        for c in there:
            dated.append(c._replace(start=start if c.start is None else c.start))
            start = dated[-1].start + (frames.get(c.path) or 0)
        there = dated
    starts = spark.createDataFrame([(c.index, c.path, c.start) for c in there], "chunk int, __own string, __start long")
    rows = rows.join(F.broadcast(starts), "__own")  # a row a chunk
    rows = rows.withColumn("frame_idx", F.col("frame_idx") + F.col("__start")).drop("__own", "__path", "__start")
    if tolerant:
        seen = {r.chunk for r in rows.select("chunk").distinct().collect()}  # a row a chunk
        for c in there:
            if c.index not in seen:
                warnings.warn(f"chunk {c.index} could not be read", stacklevel=2)
    return rows


def check_frames(rows: DataFrame, frames: int) -> DataFrame:
    """``rows``, if they are of so many frames; a stale cache is an error."""
    found = rows.agg(F.count_distinct("frame_idx")).first()[0]
    if found != frames:
        raise StaleCache(f"stale: {found} frames instead of {frames}")
    return rows


def read_summaries(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The summaries of all runs below a folder, by the name of their run; runs without one are left out."""
    rows = spark.read.json(f"{path}/run_*/summary.json", schema=schema, multiLine=True)
    return rows.withColumn("run", F.regexp_extract(F.input_file_name(), r"(run_[^/]*)/summary\.json$", 1)).orderBy("run")


def read_best_metrics(spark: SparkSession, path: str, metric: str = "metrics/mAP50-95(B)") -> DataFrame:
    """(run, epoch, best, seconds) of metric files whose headers and cells may be padded: the first row of the highest metric, and all time."""
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = rows.toDF(*[c.strip() for c in rows.columns]).withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    number = lambda c: F.col(f"`{c}`").cast("double")
    epoch = F.col("epoch").cast("long")
    return rows.groupBy("run").agg(F.max_by(epoch, F.struct(number(metric), -epoch)).alias("epoch"), F.max(number(metric)).alias("best"), F.sum(number("time")).alias("seconds"))


def write_comparison(rows: DataFrame, path: str) -> None:
    """Metric rows as a CSV file with headers; doubles have four decimals."""
    cells = [texts.fixed(F.col(c), 4).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    rows.select(*cells).coalesce(1).write.mode("overwrite").csv(path, header=True)  # a row a run
