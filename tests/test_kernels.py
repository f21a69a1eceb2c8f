"""Kernels against plain versions, analytic values and round trips."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mvtrack.functions import geometry as G
from mvtrack.operators import graph, matching, reconstruction, sequence


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lits(*v):
    return tuple(F.lit(float(x)) for x in v)


def test_closest_approach(spark):
    for a, da, b, db, want in [((0, 0, 0), (0, 0, 1), (1, 0, 0), (-1, 0, 1), 0.0), ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), 1.0), ((0, 0, 0), (0, 0, 1), (1, 0, 0), (0, 0, 2), 1.0)]:
        d, mid = G.closest_approach(lits(*a), lits(*da), lits(*b), lits(*db))
        row = one(spark, d.alias("d"), mid[0].alias("x"))
        assert math.isclose(row.d, want, abs_tol=1e-9) and math.isfinite(row.x)


def test_pair_score_of_a_perfect_match(spark):
    obs = spark.createDataFrame([(c, t, f, 1.0, 2.0, "detected") for c, t in (("a", 1), ("b", 2)) for f in range(20)], "camera_id string, track_id long, frame_idx long, u double, v double, status string")
    adjacent = matching.adjacency(obs, 1)
    score = lambda o, **k: [r.score for r in matching.pair_scores(o, adjacent, 0.03, k.get("t_min", 3), 100, 3).collect()]
    assert score(obs) == [0.2]
    assert score(obs, t_min=21) == [0.0]
    late = obs.withColumn("u", F.when((F.col("track_id") == 2) & (F.col("frame_idx") < 3), 9.0).otherwise(F.col("u")))
    assert score(late) == [0.0]


def test_project_and_refract_are_inverse(spark):
    rng = np.random.default_rng(1)
    pixels = rng.uniform(0, 1600, (50, 2))
    rows = spark.createDataFrame(pixels.tolist(), "u double, v double")
    o, d = G.refract((F.col("u"), F.col("v")), 1400.0, 800.0, 600.0, lits(0.1, -0.2, 0.0), 0.75)
    got = np.array(rows.select(*o, *d).collect(), float)
    points = got[:, :3] + 0.6 * got[:, 3:]
    camera = np.array([1400.0, 1400, 800, 600, 0.1, -0.2, 0])
    assert np.abs(reconstruction.project(points, camera, 0.75) - pixels).max() < 1e-4
    assert np.isnan(reconstruction.project(np.array([[0.0, 0.0, 0.7]]), camera, 0.75)).all()
    assert all(np.allclose(a, b) for a, b in zip(reconstruction.cast(pixels, camera, 0.75), (got[:, :3], got[:, 3:]), strict=True))


def test_decomposed_sums_equal_the_solver(spark):
    rng = np.random.default_rng(3)
    rays = np.concatenate([rng.normal(size=(12, 6)), np.ones((12, 1))], axis=1)
    rows = spark.createDataFrame(rays.tolist(), "ox double, oy double, oz double, dx double, dy double, dz double, weight double")
    sums = rows.agg(*G.triangulation_sums(G.vec("ox", "oy", "oz"), G.vec("dx", "dy", "dz"), F.col("weight")))
    got = np.array(sums.select(*G.triangulated()).first(), float)
    unit = rays[:, 3:6] / np.linalg.norm(rays[:, 3:6], axis=1, keepdims=True)
    want = reconstruction.solved(rays[None, :, :3], unit[None], np.ones((1, 12)))[0]
    assert np.allclose(got, want, atol=1e-9)


def test_curve_fit():
    assert len(reconstruction.knots(7)) == 11 and len(reconstruction.knots(4)) == 8
    u = np.linspace(0, 1, 40)
    assert np.allclose(reconstruction.basis(u).sum(1), 1)
    control = np.random.default_rng(4).normal(size=(7, 3))
    got, length = reconstruction.fit_curve(u, reconstruction.basis(u) @ control)
    assert np.allclose(got, control, atol=1e-8) and length > 0
    assert reconstruction.fit_curve(u[:8], u[:8, None].repeat(3, 1)) is None
    assert reconstruction.fit_curve(u * 0.7, u[:, None].repeat(3, 1)) is None


def test_smooth_keeps_segments_and_missing(spark):
    values = [(1, f, float(f % 2)) for f in range(20)] + [(1, 25, 7.0)] + [(2, f, None if f == 3 else 1.0) for f in range(8)]
    out = sequence.smooth(spark.createDataFrame(values, "k long, frame_idx long, z double"), ["k"], "z").collect()
    got = {(r.k, r.frame_idx): r.smoothed for r in out}
    assert got[1, 25] == 7.0 and got[2, 3] is None and abs(got[2, 4] - 1) < 1e-12
    assert all(0 <= got[1, f] <= 1 for f in range(20)) and abs(got[1, 10] - 0.5) < 0.1


MERGED = "camera_id string, track_id long, frame_idx long, u double, v double, status string"


def merged(spark, tracks, **how):
    """Tracks as (id, {frame: status}); u is the frame and v the track."""
    rows = [("c", t, f, float(f), float(t), {"d": "detected", "c": "coasted"}[s]) for t, frames in tracks for f, s in frames.items()]
    groups = spark.createDataFrame([(0, "c", t) for t, _ in tracks], "fish_id long, camera_id string, track_id long")
    out = sequence.merge_fragments(spark.createDataFrame(rows, MERGED), groups, **how).orderBy("track_id", "pos").collect()
    return [(r.track_id, r.frame_idx, round(r.v, 6), r.status[0]) for r in out]


def test_merge_fragments(spark):
    got = merged(spark, [(1, dict.fromkeys(range(3), "d")), (2, {5: "d", 6: "d"}), (3, {60: "d", 61: "c"})])
    assert got == [(1, 0, 1.0, "d"), (1, 1, 1.0, "d"), (1, 2, 1.0, "d"), (1, 3, 1.333333, "i"), (1, 4, 1.666667, "i"), (1, 5, 2.0, "d"), (1, 6, 2.0, "d"), (3, 60, 3.0, "d"), (3, 61, 3.0, "c")]


def test_merge_interleaved_fragments(spark):
    """Without a common detected frame they join, coasted rows go, and rows are in order of fragments."""
    got = merged(spark, [(1, {0: "d", 1: "d", 2: "d", 3: "c", 5: "d"}), (2, {3: "d", 4: "d", 6: "d"})])
    assert [(t, f) for t, f, *_ in got] == [(1, f) for f in (0, 1, 2, 5, 3, 4, 6)] and {s for *_, s in got} == {"d"}
    got = merged(spark, [(1, {0: "d", 5: "d"}), (2, {3: "d", 5: "d"})])
    assert {t for t, *_ in got} == {1, 2}


def test_merge_three_fragments_keeps_the_last_gap(spark):
    got = merged(spark, [(1, {0: "d"}), (2, {3: "d"}), (3, {5: "d"}), (4, {9: "c"}), (5, {10: "d"})])
    assert [(t, f, s) for t, f, _, s in got] == [(1, 0, "d"), (1, 3, "d"), (1, 4, "i"), (1, 5, "d"), (4, 9, "c"), (5, 10, "d")]


def test_merge_against_a_plain_fold(spark):
    rng = np.random.default_rng(6)
    for _ in range(3):
        tracks = []
        for t in range(14):
            at = int(rng.integers(0, 120))
            tracks.append((t, {f: "d" if rng.random() < 0.6 else "c" for f in range(at, at + int(rng.integers(1, 25))) if rng.random() < 0.8 or f == at}))
        runs, state = [], None
        for t, frames in sorted(tracks, key=lambda x: (min(x[1]), x[0])):
            own = {f for f, s in frames.items() if s == "d"}
            if state and own and state and not state & own and min(own) - max(state) - 1 <= 7:
                runs[-1].append(t)
                state |= own
            else:
                runs.append([t])
                state = own
        got = merged(spark, tracks, most_gap=7)
        assert {(r[0], f) for r in runs for t in r for f, s in dict(tracks)[t].items() if len(r) == 1 or s == "d"} == {(t, f) for t, f, _, s in got if s != "i"}



def test_communities_and_repair(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    edges = spark.createDataFrame([(1, 2, 0.9), (3, 4, 0.9), (2, 3, 0.05), (7, 8, 0.5)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 7, 8)], "node long")
    ban = spark.createDataFrame([(7, 8)], "src long, dst long")
    labels = graph.components(nodes, edges)
    assert dict(labels.collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 7: 7, 8: 7}
    got = {r.node: r.community for r in graph.communities(labels, edges, ban).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 7: 7, 8: 8}


def test_lifecycle(spark):
    from mvtrack.operators import lifecycle

    life, states = lifecycle.Life(), []
    for k, hit in enumerate([True] * 5 + [False] * 2 + [True] + [False] * 8):
        life.hit(float(k), 0.0) if hit else life.miss()
        states.append(life.state)
    assert states == ["probationary"] * 4 + ["confirmed"] + ["coasting"] * 2 + ["confirmed"] + ["coasting"] * 7 + ["dead"]
    rows = [("c", 1, f, float(f), 0.0, "detected") for f in range(6)] + [("c", 1, 8, 0.0, 0.0, "coasted")]
    out = lifecycle.lives(spark.createDataFrame(rows, "camera_id string, track_id long, frame_idx long, u double, v double, status string")).orderBy("frame_idx").collect()
    assert [r.state for r in out][4:] == ["confirmed", "confirmed", "coasting", "coasting", "coasting"]
    assert [round(r.u, 9) for r in out][5:] == [5.0, 5.8, 6.6, 7.4]  # the same step each frame
    new = [("c", 2, 0, 0.0, 0.0, "detected"), ("c", 2, 1, 3.0, 0.0, "detected"), ("c", 2, 5, 0.0, 0.0, "coasted")]
    out = lifecycle.lives(spark.createDataFrame(new, "camera_id string, track_id long, frame_idx long, u double, v double, status string")).orderBy("frame_idx").collect()
    assert [(r.state, r.u) for r in out] == [("probationary", 0.0), ("probationary", 3.0), ("probationary", 3.0), ("probationary", 3.0), ("dead", 3.0)]


def test_spline_basis():
    from mvtrack.functions import curves

    for t in (0.0, 0.1, 0.25, 0.6, 0.999, 1.0):
        assert math.isclose(sum(curves.basis(t)), 1.0) and min(curves.basis(t)) >= 0
    assert len(curves.knots(7)) == 11 and len(curves.knots(4)) == 8
    assert curves.basis(0.0)[0] == 1.0 and curves.basis(1.0)[-1] == 1.0


def test_projection_in_expressions(spark):
    rng = np.random.default_rng(4)
    points = np.column_stack([rng.uniform(-0.5, 0.5, (40, 2)), rng.uniform(0.8, 2.0, 40)])
    u, v = G.project((F.col("x"), F.col("y"), F.col("z")), 1400.0, 800.0, 600.0, lits(0.1, -0.2, 0.0), 0.75)
    got = np.array(spark.createDataFrame(points.tolist(), "x double, y double, z double").select(u, v).collect(), float)
    assert np.abs(got - reconstruction.project(points, np.array([1400.0, 1400, 800, 600, 0.1, -0.2, 0]), 0.75)).max() < 1e-9
    row = one(spark, *G.project(lits(0, 0, 0.7), 1400.0, 800.0, 600.0, lits(0, 0, 0), 0.75))
    assert row[0] is None and row[1] is None
