"""Streaming variants: windows over frames, a tracker that carries its state from batch to batch, and a loop over chunks that outlives failing ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import SCHEMA, STATE, Tracker, advance, run_frames, shown

_STATE = "frame long, tracks array<double>"


def with_time(rows: DataFrame, fps: float = 30.0) -> DataFrame:
    """Event time of each frame, counted from the epoch."""
    return rows.withColumn("at", F.timestamp_micros((F.col("frame_idx") * (1_000_000 / fps)).cast("long")))


def counts_by_chunk(rows: DataFrame, chunk: str = "10 seconds", late: str = "5 seconds", fps: float = 30.0) -> DataFrame:
    """Rows by camera in tumbling windows; frames later than ``late`` behind the newest are dropped by the watermark."""
    return with_time(rows, fps).withWatermark("at", late).groupBy(F.window("at", chunk), "camera_id").agg(F.count("*").alias("n")).select("window.start", "camera_id", "n")


def visits(rows: DataFrame, most_gap: int = 15, fps: float = 30.0) -> DataFrame:
    """Sessions of each track: a gap of more than ``most_gap`` frames starts a new one."""
    timed = with_time(rows, fps).withWatermark("at", "5 seconds")
    gap = f"{int(1_000_000 * (most_gap + 0.5) / fps)} microseconds"
    return timed.groupBy(F.session_window("at", gap), "camera_id", "track_id").agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", "camera_id", "track_id", "n")


def track(boxes: DataFrame, **how) -> DataFrame:
    """Rows of all tracks as frames come; a camera's state is its live tracks, bounded by what it sees at once.

    Frames must come in order from batch to batch; those not after the last are dropped.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, tracker = (state.get[0], Tracker.load(state.get[1], **how)) if state.exists else (None, Tracker(**how))
        rows = pd.concat(list(parts)).sort_values(["frame_idx", "det_idx"])
        out = []
        for frame, own in rows.groupby("frame_idx"):
            if last is not None and frame <= last:
                continue
            out += [(key[0], t, f, *b, s) for f, t, b, s in run_frames(tracker, last, int(frame), own[["x", "y", "w", "h"]].to_numpy(float))]
            last = int(frame)
        state.update((last, tracker.dump()))
        yield pd.DataFrame(out, columns=["camera_id", "track_id", "frame_idx", "x", "y", "w", "h", "status"])

    return boxes.groupBy("camera_id").applyInPandasWithState(run, SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)


def _state_of(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    """What the batch before left."""
    return spark.read.schema(STATE).parquet(f"{folder}/state/batch={batch - 1}") if batch else None


def _forget(states: DataFrame | None, spark: SparkSession) -> DataFrame:
    """After a failed chunk no track goes on, and one number is left out, so that none names two animals."""
    if states is None:
        return spark.createDataFrame([], STATE)
    return states.withColumns({"frame_idx": F.lit(None).cast("long"), "state": F.array(F.lit(0.0), F.element_at("state", 2) + 1)})


def track_chunks(boxes: DataFrame, folder: str, least_hits: int = 3, prepare: Callable[[DataFrame], DataFrame] | None = None, **how) -> StreamingQuery:
    """Track a stream chunk by chunk, a micro-batch each, and write rows, states and failures below ``folder``.

    ``prepare`` may change a chunk before it is tracked.  A chunk that fails is
    recorded with its frames and its error; its tracks end there, and the stream
    goes on.  All that a batch writes goes to a folder of its number and replaces
    what is there, so a batch that runs again after a restart leaves one copy.
    Frames must come in order.  The returned query is started, and ends when the
    source has nothing more.
    """

    def one(chunk: DataFrame, batch: int) -> None:
        spark = chunk.sparkSession
        states = _state_of(spark, folder, batch)
        try:
            made = advance(prepare(chunk) if prepare else chunk, states, least_hits=least_hits, **how)
            made.write.mode("overwrite").parquet(f"{folder}/made/batch={batch}")
            made = spark.read.schema(f"{SCHEMA}, state array<double>").parquet(f"{folder}/made/batch={batch}")
            after = made.where("state IS NOT NULL").select("camera_id", "frame_idx", "state")
            rows = shown(made.where("state IS NULL").drop("state"), least_hits)
            rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
            failure = []
        except Exception as error:  # whatever a chunk fails by, the next ones go on
            after = _forget(states, spark)
            span = chunk.agg(F.min("frame_idx"), F.max("frame_idx")).first()
            failure = [(batch, *span, str(error)[:1000])]
            spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
        spark.createDataFrame(failure, "chunk long, first_frame long, last_frame long, error string").write.mode("overwrite").parquet(f"{folder}/failures/batch={batch}")
        after.write.mode("overwrite").parquet(f"{folder}/state/batch={batch}")

    return boxes.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
