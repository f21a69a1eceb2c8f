"""Operators along frames: gaps, islands, fills, trails and splits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRACK = ["camera_id", "track_id"]


def islands(rows: DataFrame, keys: list[str], most_gap: int = 1) -> DataFrame:
    """Rows with the number of their run of frames; a step of more than ``most_gap`` starts a new one."""
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    start = F.when(F.col("frame_idx") - F.lag("frame_idx").over(w) > most_gap, 1).otherwise(0)
    return rows.withColumn("__start", start).withColumn("island", F.sum("__start").over(w)).drop("__start")


def fill_gaps(rows: DataFrame, keys: list[str], columns: list[str], most_gap: int = 5) -> DataFrame:
    """Rows, and linearly interpolated ones for up to ``most_gap`` missing frames between two."""
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    ahead = rows.withColumn("__next", F.lead(F.struct("frame_idx", *columns)).over(w)).withColumn("__gap", F.col("__next.frame_idx") - F.col("frame_idx") - 1)
    made = ahead.where(f"__gap BETWEEN 1 AND {most_gap}").withColumn("__k", F.explode(F.expr("sequence(1L, __gap)")))
    share = F.col("__k").cast("double") / (F.col("__gap") + 1)
    new = made.select(*keys, (F.col("frame_idx") + F.col("__k")).alias("frame_idx"), *[(F.col(c) + (F.col(f"__next.{c}") - F.col(c)) * share).alias(c) for c in columns], F.lit(True).alias("interpolated"))
    return rows.select(*keys, "frame_idx", *columns, F.lit(False).alias("interpolated")).unionAll(new)


def velocities(obs: DataFrame) -> DataFrame:
    w = Window.partitionBy(*TRACK).orderBy("frame_idx")
    rows = obs.withColumn("du", F.col("u") - F.lag("u").over(w)).withColumn("dv", F.col("v") - F.lag("v").over(w))
    return rows.where("du IS NOT NULL").select(*TRACK, "frame_idx", F.round("du", 6).alias("du"), F.round("dv", 6).alias("dv"), F.round(F.sqrt(F.col("du") ** 2 + F.col("dv") ** 2), 6).alias("speed"))


def trails(obs: DataFrame, length: int = 30) -> DataFrame:
    """Each observation with the positions of the rows before it, up to ``length``, and its own."""
    w = Window.partitionBy(*TRACK).orderBy("frame_idx").rowsBetween(-length, 0)
    return obs.withColumn("trail", F.collect_list(F.struct("frame_idx", "u", "v")).over(w))


def sampled_frames(frames: DataFrame, k: int) -> DataFrame:
    """Evenly spread frames, both ends included; all where there are no more than k."""
    ranked = frames.select("frame_idx").distinct()
    n = ranked.count()
    if n <= k:
        return ranked
    spots = [int(x) for x in np.linspace(0, n - 1, k)]
    return numbered(ranked, "__at", "frame_idx").where(F.col("__at").isin(spots)).select("frame_idx")


def checkpointed(rows: DataFrame) -> DataFrame:
    """A copy in the session's checkpoint folder, which all executors share; a local session may have one of its own.

    It is a Parquet table: what plans know of its size is that of its files, where
    a checkpoint keeps the estimate of the plan before it, which loops of joins
    multiply from round to round.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    path = f"{sc.getCheckpointDir()}/rows-{uuid.uuid4()}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows with their number in the order, from 0: ranges of the order, a count for each, and a number within it.

    The ranges are fixed by a checkpoint, as two plans may draw them differently.
    """
    parts = checkpointed(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a partition
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + own).cast("bigint")).drop("__part", "__before")


def smallest(rows: DataFrame, digest: str, tie: list[str], take: int) -> DataFrame:
    """The ``take`` rows of least hexadecimal ``digest``, then ``tie``.

    Counts by the first four digits, 65,536 at most, tell which rows come whole;
    only those of the digits in between are sorted.
    """
    if take <= 0:
        return rows.limit(0)
    front = F.substring(digest, 1, 4)
    before, edge, rest = 0, None, 0
    for r in rows.groupBy(front.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        if before + r.n >= take:
            edge, rest = r.p, take - before
            break
        before += r.n
    if edge is None:
        return rows
    return rows.where(front < edge).unionByName(rows.where(front == edge).orderBy(digest, *tie).limit(rest))


def slots(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` ids of each frame, numbered from 0."""
    n = F.row_number().over(Window.partitionBy("frame_idx").orderBy("fish_id"))
    return rows.withColumn("slot", (n - 1).cast("bigint")).where(F.col("slot") < most)


def stratified_split(rows: DataFrame, stratum: str, identity: str, share: float, seed: int) -> DataFrame:
    """Rows marked ``val`` or ``train``: in each stratum the share, one at least, of smallest hash."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(identity).cast("string")))
    w = Window.partitionBy(stratum)
    ranked = rows.withColumn("__rank", F.row_number().over(w.orderBy(h, identity))).withColumn("__n", F.count("*").over(w))
    take = F.greatest(F.lit(1), F.bround(F.col("__n") * share).cast("int"))
    return ranked.withColumn("split", F.when(F.col("__rank") <= take, "val").otherwise("train")).drop("__rank", "__n")


def gaussian(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter with mirrored ends, cut at four deviations."""
    radius = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    padded = np.pad(values, radius, mode="symmetric")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def smooth(rows: DataFrame, keys: list[str], value: str, sigma: float = 3.0) -> DataFrame:
    """Rows with ``smoothed``: by island of consecutive frames, missing values bridged for the filter and left missing."""
    held = islands(rows.select(*keys, "frame_idx", value), keys)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            out = []
            for own in series:
                v = np.array(own, float)
                known = np.isfinite(v)
                if len(v) > 1 and known.any():
                    at = np.arange(len(v))
                    v = np.where(known, gaussian(np.interp(at, at[known], v[known]), sigma), np.nan)
                out.append([None if np.isnan(x) else float(x) for x in v])
            yield pd.Series(out, dtype=object)

    # An array an island, so that one call takes many islands.
    island = held.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct("frame_idx", value))).alias("r"))
    made = island.select(*keys, "island", "r", run(F.col(f"r.{value}")).alias("s"))
    out = made.select(*keys, "island", F.explode(F.arrays_zip("r", "s")).alias("z"))
    return out.select(*keys, F.col("z.r.frame_idx").alias("frame_idx"), F.col(f"z.r.{value}").alias(value), "island", F.col("z.s").alias("smoothed"))


def fragment_runs(obs: DataFrame, groups: DataFrame, most_gap: int = 30) -> DataFrame:
    """(fish_id, camera_id, track_id, first, last, at, run, members): fragments of one (fish_id, camera_id) in order of their first frames, and the run that each is in.

    A fragment joins the run before it unless one of that run has a detected frame
    that it has too, or its first detected frame is more than ``most_gap`` frames
    after all detected ones of the run; a fragment without detected frames is a
    run of its own.  Interleaved fragments may join.  ``run`` is the first
    fragment's track, ``at`` the place in the run.

    What conflicts, and how far, is told by windows over rows; the fold passes
    over one row a fragment, streamed through sorted partitions.
    """
    rows = obs.join(groups, TRACK).select("fish_id", *TRACK, "frame_idx", "status")
    own = ["fish_id", "camera_id"]
    spans = rows.groupBy(*own, "track_id").agg(F.min("frame_idx").alias("begin"), *[f(F.when(F.col("status") == "detected", F.col("frame_idx"))).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))])
    seen = rows.where("status = 'detected'").join(spans.select(*own, "track_id", "begin"), [*own, "track_id"])
    # Of the fragments that share a detected frame, each conflicts with the one before it in order.
    before = F.lag(F.struct("begin", "track_id")).over(Window.partitionBy(*own, "frame_idx").orderBy("begin", "track_id"))
    clash = seen.withColumn("clash", before).groupBy(*own, "track_id").agg(F.max("clash").alias("clash"))
    dealt = spans.join(clash, [*own, "track_id"], "left").select(*own, "track_id", "begin", "first", "last", F.col("clash.begin").alias("clash_begin"), F.col("clash.track_id").alias("clash_track"))
    dealt = dealt.repartition(*own).sortWithinPartitions(*own, "begin", "track_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, run, start, end, at = None, None, None, None, 0
        for batch in batches:
            runs, places = [], []
            for fish, camera, track, begin, first, last, clash_begin, clash_track in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                clear = clash_track is None or start is None or (clash_begin, clash_track) < start
                if (fish, camera) == key and clear and end is not None and first is not None and first - end - 1 <= most_gap:
                    end, at = max(end, last), at + 1
                else:
                    key, run, start, end, at = (fish, camera), track, (begin, track), last, 0
                runs.append(run)
                places.append(at)
            cells = [*(batch.column(c) for c in (*own, "track_id", "first", "last")), pa.array(places, pa.int64()), pa.array(runs, pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, names=[*own, "track_id", "first", "last", "at", "run"])

    folded = dealt.mapInArrow(fold, "fish_id long, camera_id string, track_id long, first long, last long, at long, run long")
    return folded.withColumn("members", F.count("*").over(Window.partitionBy(*own, "run")))


def merge_fragments(obs: DataFrame, groups: DataFrame, most_gap: int = 30) -> DataFrame:
    """Rows (fish_id, camera_id, track_id, frame_idx, columns, status, pos) of the runs of ``fragment_runs``, each under its first track.

    ``obs`` has (camera_id, track_id, frame_idx, status) and numbers, as centroids
    and boxes; ``groups`` (fish_id, camera_id, track_id), a track in one fish.  A
    fragment by itself keeps all its rows.  Of joined ones the detected rows stay,
    in order of fragments (``pos`` is their place, as interleaved ones aren't in
    order of frames), and the gap before the last one is filled linearly, from the
    row before it to its first; gaps before that one stay open, as the rows
    surveyed leave them when a third fragment joins.
    """
    own = ["fish_id", "camera_id", "run"]
    columns = [c for c in obs.columns if c not in (*TRACK, "frame_idx", "status")]
    runs = checkpointed(fragment_runs(obs, groups, most_gap))
    rows = obs.join(runs, TRACK).where("members = 1 OR status = 'detected'")
    made = rows.select(*own, "at", "frame_idx", *columns, "status", F.lit(0).alias("filled"))
    ends = rows.where("members > 1 AND at >= members - 2")
    last = ends.where("at = members - 2").groupBy(*own).agg(F.max_by(F.struct(*columns), "frame_idx").alias("a"))
    first = ends.where("at = members - 1").groupBy(*own).agg(F.min_by(F.struct(*columns), "frame_idx").alias("b"), F.min("frame_idx").alias("to"), F.max("at").alias("at"))
    until = runs.where("at < members - 1").groupBy(*own).agg(F.max("last").alias("from"))
    gaps = until.join(last, own).join(first, own).where("to - from > 1").withColumn("frame_idx", F.explode(F.expr("sequence(from + 1, to - 1)")))
    share = (F.col("frame_idx") - F.col("from")).cast("double") / (F.col("to") - F.col("from"))
    between = [(F.col(f"a.{c}") + share * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(c) for c in columns]
    fill = gaps.select(*own, "at", "frame_idx", *between, F.lit("interpolated").alias("status"), F.lit(-1).alias("filled"))
    order = Window.partitionBy(*own).orderBy("at", "filled", "frame_idx")
    out = made.unionByName(fill).withColumn("pos", F.row_number().over(order) - 1)
    return out.select("fish_id", "camera_id", F.col("run").alias("track_id"), "frame_idx", *columns, "status", F.col("pos").cast("long").alias("pos"))


def jitters(rows: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """A hundred times the mean absolute step of each column of ``names`` from frame to frame, under its new name; steps with a null or nan side don't count, and series without a step have no row."""
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    step = {new: F.abs(F.col(c) - F.lag(c).over(w)) for c, new in names.items()}
    rows = rows.select(*keys, *[F.when(~F.isnan(s), s).alias(n) for n, s in step.items()]).where(" OR ".join(f"{n} IS NOT NULL" for n in step))
    return rows.groupBy(*keys).agg(*[F.round(F.avg(n) * 100, 5).alias(n) for n in step])
