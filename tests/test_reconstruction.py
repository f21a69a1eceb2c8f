import numpy as np
import pytest
from pyspark.sql import functions as F

from mvtrack.operators import reconstruction as R

WATER = 0.75
VIEWS = "frame_idx long, fish_id long, point long, camera_id string, fx double, fy double, cx double, cy double, px double, py double, pz double, u double, v double, confidence double, half_width double"
RIG = [(f"c{k}", 1400.0 + 10 * k, 1420.0 - 5 * k, 800.0, 600.0, 0.3 * (k % 3) - 0.3, 0.4 * (k // 3) - 0.2, 0.0) for k in range(6)]


def seen(frame, fish, points, rig=RIG, edit=lambda k, c, u, v: (u, v), confidence=lambda k, c: 1.0):
    """Rows of views of points (n, 3)."""
    rows = []
    for k, p in enumerate(points):
        for c, (name, *camera) in enumerate(rig):
            u, v = R.project(p[None], np.array([camera]), WATER)[0].tolist()
            u, v = edit(k, c, u, v)
            rows.append((frame, fish, k, name, *camera, u, v, confidence(k, c), 5.0 + c))
    return rows


def body(n=12, bend=0.05, z=1.3):
    t = np.linspace(0, 1, n)
    return np.column_stack([0.1 * t, bend * np.sin(2 * t), z + 0.02 * t])


def frame(spark, rows):
    return spark.createDataFrame([(*r[:4], *[None if x is None else float(x) for x in r[4:]]) for r in rows], VIEWS)


def points(df):
    return {(r.frame_idx, r.fish_id, r.point): (r.x, r.y, r.z, r.n_cameras, r.mean_residual) for r in df.collect()}


def one_by_one(rows, outlier=10.0):
    """The scalar form of the iterative rule, a camera at a time."""
    out = {}
    for key in sorted({r[:3] for r in rows}):
        own = [r for r in rows if r[:3] == key and r[11] is not None]
        cameras, pixels = np.array([r[4:11] for r in own], float), np.array([r[11:13] for r in own], float)
        w = np.sqrt([1.0 if r[13] is None else r[13] for r in own])
        if len(own) < 2:
            continue
        while True:
            o, d = R.cast(pixels, cameras, WATER)
            plane = [np.eye(3) - np.outer(x, x) for x in d]
            p = np.linalg.solve(sum(a * m for a, m in zip(w, plane)), sum(a * m @ x for a, m, x in zip(w, plane, o)))
            off = np.linalg.norm(R.project(p, cameras, WATER) - pixels, axis=1)
            off = np.where(np.isnan(off), np.inf, off)
            if len(off) <= 2 or off.max() <= outlier:
                break
            keep = np.arange(len(off)) != off.argmax()
            cameras, pixels, w = cameras[keep], pixels[keep], w[keep]
        if p[2] > WATER:
            out[key] = (*p, len(off), off.mean())
    return out


def test_the_worst_camera_leaves_first(spark):
    """Errors of several cameras in some points, lost pixels, unknown confidences; against the scalar rule."""
    rng = np.random.default_rng(1)
    rows = []
    for fish in range(12):
        bad = {(k, c): rng.normal(size=2) * 80 for k in range(12) for c in range(6) if rng.random() < 0.15}
        rows += seen(3, fish, body(bend=0.01 * fish), edit=lambda k, c, u, v: (None, None) if rng.random() < 0.2 else (u + bad.get((k, c), (0, 0))[0], v + bad.get((k, c), (0, 0))[1]), confidence=lambda k, c: None if k == 3 else 0.2 + 0.1 * c)  # noqa: B023
    got, want = points(R.robust_points(frame(spark, rows).repartition(3), WATER)), one_by_one(rows)
    assert got.keys() == want.keys() and len(got) > 100
    assert all(np.allclose(got[k], want[k], atol=1e-7) for k in got)


def test_both_rules_agree_where_one_shot_is_enough(spark):
    """A single outlier that doesn't draw the others beyond the threshold: within 1e-4 of each other, and of the truth."""
    rows = []
    for fish in range(5):
        rows += seen(0, fish, body(bend=0.01 * fish), edit=lambda k, c, u, v: (u + 25 * (c == (k + fish) % 6), v))  # noqa: B023
    df = frame(spark, rows)
    a, b = points(R.robust_points(df, WATER)), points(R.one_shot_points(df, WATER))
    assert a.keys() == b.keys() and len(a) == 60
    assert all(np.abs(np.array(a[k]) - np.array(b[k])).max() < 1e-4 for k in a)
    assert all(np.abs(np.array(a[0, f, k][:3]) - body(bend=0.01 * f)[k]).max() < 1e-6 and a[0, f, k][3] == 5 for f in range(5) for k in range(12))


def test_two_cameras(spark):
    """Kept whatever the residual by one rule; by the other they need an angle and residuals."""
    far, near = [RIG[0], RIG[5]], [("a", *RIG[0][1:]), ("b", *RIG[0][1:5], RIG[0][5] + 0.005, *RIG[0][6:])]
    rows = seen(0, 0, body(), rig=far) + seen(0, 1, body(), rig=near) + seen(0, 2, body(), rig=far, edit=lambda k, c, u, v: (u, v + 60 * c)) + seen(0, 3, body(), rig=far[:1])
    df = frame(spark, rows)
    assert {k[1] for k in points(R.robust_points(df, WATER))} == {0, 1, 2}
    assert {k[1] for k in points(R.one_shot_points(df, WATER))} == {0}


def test_nothing_above_the_surface(spark):
    """Rays that meet at or above it."""
    up = seen(0, 0, body(z=0.7501), edit=lambda k, c, u, v: (800 + (u - 800) * 1.4, 600 + (v - 600) * 1.4))
    df = frame(spark, up)
    assert points(R.robust_points(df, WATER)) == points(R.one_shot_points(df, WATER)) == {}
    assert points(R.robust_points(df.limit(0), WATER)) == {}


@pytest.mark.parametrize("flat", [True, False])
def test_curves_widths_and_residuals(spark, flat):
    df = frame(spark, seen(7, 2, body()))
    r = R.reconstruct(df, 12, WATER, flat=flat).first()
    control = np.array(r.control).reshape(-1, 3)
    fitted = R.basis(np.linspace(0, 1, 12)) @ control
    truth = body()
    assert np.abs(fitted[:, :2] - truth[:, :2]).max() < 2e-4 and (r.frame_idx, r.fish_id, r.n_cameras) == (7, 2, 6) and not r.is_low_confidence
    if flat:
        assert np.allclose(fitted[:, 2], truth[:, 2].mean()) and np.isclose(r.centroid_z, truth[:, 2].mean())
        assert np.allclose(r.z_offsets, truth[:, 2] - truth[:, 2].mean(), atol=1e-6)
    else:
        assert r.centroid_z is None and r.z_offsets is None and r.max_residual < 0.5
    widths = 7.5 * (truth[:, 2] - WATER) / ((RIG[0][1] + RIG[0][2]) / 2)
    assert np.allclose(r.half_widths, widths, atol=1e-6)
    off = {c: np.linalg.norm(R.project(fitted, np.array(rest), WATER) - R.project(truth, np.array(rest), WATER), axis=1) for c, *rest in RIG}
    assert set(r.per_camera) == set(off) and all(np.isclose(r.per_camera[c], off[c].mean(), atol=1e-6) for c in off)
    assert np.isclose(r.mean_residual, np.concatenate(list(off.values())).mean(), atol=1e-6) and np.isclose(r.max_residual, max(o.max() for o in off.values()), atol=1e-6)


def test_what_gives_no_curve(spark):
    def without(gone):
        return lambda k, c, u, v: (None, None) if k in gone else (u, v)

    rows = seen(0, 0, body(), edit=without({0, 1, 2})) + seen(0, 1, body(), edit=without({4, 5, 6, 7})) + seen(0, 2, body(), edit=without({5, 6})) + seen(0, 3, body(), rig=RIG[:1])
    rows += seen(0, 4, body(), edit=lambda k, c, u, v: (u, v) if c < 2 or k > 2 else (None, None))
    got = {r.fish_id: r for r in R.reconstruct(frame(spark, rows), 12, WATER).collect()}
    assert set(got) == {2, 4} and got[2].z_offsets[5] is None and got[2].z_offsets[4] is not None
    assert got[4].is_low_confidence and got[4].n_cameras == 2 and not got[2].is_low_confidence


def test_the_chain_counts_cameras_twice_and_fills_gaps(spark):
    """A frame with two detected cameras, one with three of which one has no midline near, a gap of one frame, one of six."""
    cameras = spark.createDataFrame([r for r in RIG], "camera_id string, fx double, fy double, cx double, cy double, px double, py double, pz double")
    tracks, midlines = [], []
    for f in [0, 1, 2, 3, 5, 12]:
        rows = seen(f, 4, body() + [0.001 * f, 0, 0])
        for c, (name, *_) in enumerate(RIG):
            own = [(r[11], r[12], r[13], r[14]) for r in rows if r[3] == name]
            u, v = np.mean([o[:2] for o in own], axis=0).tolist()
            status = "coasted" if f == 1 and c > 1 else "detected"
            tracks.append((4, name, 9, f, u + 1, v, status))
            midlines += [(f, name, 1, u + 2, v, [(1.0, 1.0, 1.0, 1.0)] * 12), (f, name, 0, u, v, None if f == 2 and c > 1 else own)]  # of equally near ones the first
    schema = "fish_id long, camera_id string, track_id long, frame_idx long, u double, v double, status string"
    lines = spark.createDataFrame(midlines, "frame_idx long, camera_id string, det_idx long, u double, v double, points array<struct<u:double,v:double,confidence:double,half_width:double>>")
    out = R.reconstruct_groups(spark.createDataFrame(tracks, schema), lines, cameras, 12, WATER).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.n_cameras) for r in out] == [(0, 6), (1, 0), (2, 0), (3, 6), (4, 0), (5, 6), (12, 6)]
    a, b, c = (np.array(next(r for r in out if r.frame_idx == f).control) for f in (0, 1, 3))
    assert np.allclose(b, a * 2 / 3 + c / 3) and out[1].is_low_confidence and out[1].half_widths == out[0].half_widths


def test_filled_lengths(spark):
    made = R.fill_curves(R.reconstruct(frame(spark, seen(0, 0, body()) + seen(4, 0, body(bend=0.1)) + seen(4, 1, body())), 12, WATER)).select("fish_id", "frame_idx", F.round("arc_length", 9).alias("l")).collect()
    got = {(r.fish_id, r.frame_idx): r.l for r in made}
    assert set(got) == {(0, f) for f in range(5)} | {(1, 4)} and np.isclose(got[0, 1], 0.75 * got[0, 0] + 0.25 * got[0, 4])
