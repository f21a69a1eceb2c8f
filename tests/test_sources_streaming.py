"""Files in and out, chunks, and streams against batches."""

import json

import pandas as pd
from pyspark.sql import functions as F

from mvtrack.operators import store, tracking
from mvtrack.sources import labels, snapshots
from mvtrack.streaming import chunks

BOXES = "camera_id string, frame_idx long, det_idx long, x double, y double, w double, h double"


def test_labels_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.2 0.2 0.4 0.4 2 0.6 0.6 2\n0 1 1\n\n")
    (tmp_path / "b.txt").write_text("0 0.1 0.1 0.1 0.1 0.25 0.5 2 0 0 0\n")
    rows = labels.read_pose_labels(spark, str(tmp_path), 2)
    assert sorted((r.stem, r.line_no, [p.visible for p in r.points]) for r in rows.collect()) == [("a", 0, [True, True]), ("b", 0, [True, False])]
    sizes = spark.createDataFrame([("a", 100, 50), ("b", 200, 100)], "stem string, width int, height int")
    notes = labels.to_annotations(rows, sizes)
    assert [r.keypoints for r in notes.orderBy("image_id").collect()] == [[40.0, 20.0, 2.0, 60.0, 30.0, 2.0], [50.0, 50.0, 2.0, 0.0, 0.0, 0.0]]
    lines = {r.stem: r.line for r in labels.to_label_lines(notes).collect()}
    assert lines["a"] == "0 0.500000 0.500000 0.200000 0.200000 0.400000 0.400000 2 0.600000 0.600000 2"


def test_annotations(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 128, "height": 64}, {"id": 2, "file_name": "b.jpg", "width": 1, "height": 1}], "annotations": [{"id": 5, "image_id": 1, "keypoints": [1, 2, 2]}, {"id": 6, "image_id": 1, "keypoints": [0, 0, 0]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    rows = labels.read_annotations(spark, str(tmp_path / "c.json")).collect()
    assert sorted((r.image_id, r.annotation_id or 0) for r in rows) == [(1, 5), (1, 6), (2, 0)]


def test_chunks(spark, tmp_path):
    parts = str(tmp_path / "c")
    for chunk in (0, 1):
        snapshots.write_chunk(spark.range(3).select(F.col("id").alias("frame_idx")), parts, chunk)
    snapshots.write_chunk(spark.range(2).select(F.col("id").alias("frame_idx")), parts, 1)
    assert sorted(r.frame_idx for r in snapshots.read_chunks(spark, parts, 10).collect()) == [0, 1, 2, 10, 11]


def test_appended_frames(spark, tmp_path):
    """Slots by fish, the surplus left out, and a batch that runs twice counts once."""
    path = str(tmp_path / "f")
    for batch in (0, 1, 1):
        rows = [(10 * batch + f, fish, 0.5) for f in range(2) for fish in (7, 3, 5)]
        snapshots.append_frames(spark.createDataFrame(rows, "frame_idx long, fish_id long, x double"), path, batch, most=2)
    got = sorted((r.frame_idx, r.slot, r.fish_id) for r in snapshots.read_frames(spark, path).collect())
    assert got == [(f, s, (3, 5)[s]) for f in (0, 1, 10, 11) for s in (0, 1)]


def test_upsert_by_priority(spark):
    schema = "sample_id long, content_hash string, priority long, created long"
    old = spark.createDataFrame([(1, "a", 1, 1), (2, "b", 1, 2), (3, "c", 1, 3)], schema)
    new = spark.createDataFrame([(4, "a", 2, 4), (5, "b", 1, 5), (6, "c", 0, 6), (7, "d", 0, 7)], schema)
    got = {r.content_hash: (r.sample_id, r.action) for r in store.upsert(old, new).collect()}
    assert got == {"a": (4, "upserted"), "b": (5, "upserted"), "c": (3, "kept"), "d": (7, "inserted")}


def run_stream(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_tracker_stream_equals_batch(spark, tmp_path):
    rows = [("c", f, 0, 10.0 + 2 * f, 10.0, 8.0, 8.0) for f in range(12) if f != 5] + [("d", f, 0, 5.0, 5.0 + f, 9.0, 9.0) for f in range(9)]
    frame = pd.DataFrame(rows, columns=["camera_id", "frame_idx", "det_idx", "x", "y", "w", "h"])
    want = {tuple(r) for r in tracking.track(spark.createDataFrame(frame, BOXES), least_hits=1).collect()}
    for k, part in enumerate((frame[frame.frame_idx < 6], frame[frame.frame_idx >= 6])):
        spark.createDataFrame(part, BOXES).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(BOXES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {tuple(r) for r in run_stream(spark, chunks.track(stream, least_hits=1), "tracks").collect()}
    assert got == want and any(r[-1] == "coasted" for r in got)


def test_counts_by_chunk(spark, tmp_path):
    rows = [("c", f) for f in range(700)]
    spark.createDataFrame(rows, "camera_id string, frame_idx long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("camera_id string, frame_idx long").parquet(f"{tmp_path}/in")
    got = [r.n for r in run_stream(spark, chunks.counts_by_chunk(stream), "counts").orderBy("start").collect()]
    assert got[:1] == [300]


def test_visits(spark, tmp_path):
    """A gap of more than 15 frames begins a new visit."""
    frames = [*range(10), *range(20, 30), *range(46, 50), *range(5000, 5001)]
    rows = [("c", t, f) for f in frames for t in (1, 2) if t == 1 or f < 30 or f >= 5000]
    spark.createDataFrame(rows, "camera_id string, track_id long, frame_idx long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("camera_id string, track_id long, frame_idx long").parquet(f"{tmp_path}/in")
    got = sorted((r.track_id, r.n) for r in run_stream(spark, chunks.visits(stream), "visits").collect())
    assert got == [(1, 4), (1, 20), (2, 20)]
