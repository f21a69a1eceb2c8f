"""Run folders: round trips and what is missing."""

import json
import warnings

import pytest
from pyspark.sql import functions as F

from mvtrack.sources import runs as R


def test_calibration(spark, tmp_path):
    eye = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    turned = [[0.0, 1.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    k = [[1400.0, 0.0, 800.0], [0.0, 1390.0, 600.0], [0.0, 0.0, 1.0]]
    doc = {"water_z": 0.75, "cameras": {"a": {"K": k, "R": eye, "t": [0.1, 0.2, 0.3], "width": 1600, "height": 1200}, "b": {"K": k, "R": turned, "t": [1.0, 2.0, 0.0], "width": 1600, "height": 1200}}}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    rows = {r.camera_id: r for r in R.read_calibration(spark, str(tmp_path / "c.json")).collect()}
    assert (rows["a"].fx, rows["a"].fy, rows["a"].cx, rows["a"].water_z, rows["a"].n_water) == (1400.0, 1390.0, 800.0, 0.75, 1.333)
    assert [rows["a"][c] for c in "xyz"] == [-0.1, -0.2, -0.3]
    assert [rows["b"][c] for c in "xyz"] == [2.0, -1.0, 0.0]


def test_tables_are_guarded_by_their_hash(spark, tmp_path):
    path = str(tmp_path / "lut")
    assert R.load_table(spark, path, "h") is None
    R.save_table(spark.range(5), path, "h")
    assert R.load_table(spark, path, "h").count() == 5
    assert R.load_table(spark, path, "other") is None


def test_runs_by_manifest(spark, tmp_path):
    for k, extra in ((0, False), (1, True)):
        rows = spark.range(10).select(F.col("id").alias("frame_idx"), F.lit("cam").alias("camera_id"))
        (rows.withColumn("v", F.lit(1.0)) if extra else rows).write.parquet(str(tmp_path / f"chunk_{k}"))
    listed = [{"index": 1, "path": "chunk_1", "start": 10}, {"index": 0, "path": "chunk_0", "start": 0}, {"index": 2, "path": "chunk_2", "start": 20}]
    (tmp_path / "manifest.json").write_text(json.dumps({"chunks": listed}))
    with pytest.warns(UserWarning, match="chunk 2"):
        rows = R.read_run(spark, str(tmp_path)).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in rows] == list(range(20)) and [r.chunk for r in rows] == [0] * 10 + [1] * 10
    assert [r.v for r in rows] == [None] * 10 + [1.0] * 10
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        frame = R.read_run(spark, str(tmp_path))
        assert R.check_frames(frame, 20) is frame
        with pytest.raises(ValueError, match="stale"):
            R.check_frames(frame, 21)


def test_summaries_and_metrics(spark, tmp_path):
    for name, best in (("run_2", 0.5), ("run_1", 0.7)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary.json").write_text(json.dumps({"best": best, "epochs": 3}))
        (tmp_path / name / "results.csv").write_text("  epoch ,  time, metrics/mAP50-95(B)\n 1 , 2.5,  0.1\n 2, 2.5, 0.6 \n 3, 1.0,  0.6\n")
    (tmp_path / "run_3").mkdir()
    rows = R.read_summaries(spark, str(tmp_path), "best double, epochs int").collect()
    assert [(r.run, r.best) for r in rows] == [("run_1", 0.7), ("run_2", 0.5)]
    metrics = R.read_best_metrics(spark, str(tmp_path / "run_*" / "results.csv"))
    assert sorted((r.run, r.epoch, r.best, r.seconds) for r in metrics.collect()) == [("run_1", 2, 0.6, 6.0), ("run_2", 2, 0.6, 6.0)]
    R.write_comparison(metrics, str(tmp_path / "out"))
    assert sorted(r.best for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()) == ["0.6000", "0.6000"]


def test_tolerant_reading_reports_what_it_skips(spark, tmp_path):
    for k in (0, 1, 2):
        spark.range(5).select(F.col("id").alias("frame_idx"), F.lit(k).alias("k")).coalesce(1).write.parquet(str(tmp_path / f"d/chunk_{k}"))
    broken = next((tmp_path / "d/chunk_1").glob("*.parquet"))
    broken.write_bytes(broken.read_bytes()[:100])
    for crc in (tmp_path / "d/chunk_1").glob(".*.crc"):
        crc.unlink()
    (tmp_path / "manifest.json").write_text(json.dumps({"chunks": [{"index": k, "path": f"d/chunk_{k}", "start": 5 * k} for k in range(3)]}))
    with pytest.warns(UserWarning, match="chunk 1 could not be read"):
        rows = R.read_run(spark, str(tmp_path), tolerant=True).collect()
    assert sorted((r.chunk, r.frame_idx) for r in rows) == [(k, 5 * k + f) for k in (0, 2) for f in range(5)]
    with pytest.raises(Exception):  # noqa: B017
        R.read_run(spark, str(tmp_path)).collect()


def test_caches_are_checked(spark, tmp_path):
    path, schema = str(tmp_path / "c"), "frame_idx long, v double"
    rows = spark.range(6).select((F.col("id") % 3).alias("frame_idx"), F.lit(1.0).alias("v"))
    R.write_cache(rows, path, 3)
    assert R.read_cache(spark, path, schema).count() == 6
    with pytest.raises(R.StaleCache, match="lacks w int"):
        R.read_cache(spark, path, schema + ", w int")
    with pytest.raises(R.StaleCache, match="lacks v float"):
        R.read_cache(spark, path, "frame_idx long, v float")
    with pytest.raises(R.StaleCache, match="fingerprint"):
        R.read_cache(spark, path, "frame_idx long")
    with pytest.warns(UserWarning, match="fingerprint"):
        assert R.read_cache(spark, path, "frame_idx long", strict=False).columns == ["frame_idx", "v"]
    R.write_cache(rows, path, 4)
    with pytest.raises(R.StaleCache, match="3 frames instead of 4"):
        R.read_cache(spark, path, schema)


def test_folders_stand_in_for_a_manifest(spark, tmp_path):
    assert R.read_run(spark, str(tmp_path)) is None
    for k, n in ((10, 2), (2, 5), (0, 3)):
        spark.range(n).select(F.col("id").alias("frame_idx"), F.lit(k).alias("k")).coalesce(1).write.parquet(str(tmp_path / f"chunk_{k:02d}"))
    rows = R.read_run(spark, str(tmp_path)).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.chunk, r.k) for r in rows] == [(f, k, k) for f, k in enumerate([0] * 3 + [2] * 5 + [10] * 2)]
    # A start that is given counts, and what has none goes on from there.
    (tmp_path / "manifest.json").write_text(json.dumps({"chunks": [{"index": 0, "path": "chunk_00"}, {"index": 1, "path": "chunk_02", "start": 20}, {"index": 2, "path": "chunk_10"}]}))
    rows = R.read_run(spark, str(tmp_path)).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.chunk) for r in rows] == [(f, 0) for f in range(3)] + [(f, 1) for f in range(20, 25)] + [(f, 2) for f in range(25, 27)]
