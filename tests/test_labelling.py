"""Label generation against a plain version in numpy, a curve and a camera at a time."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mvtrack.functions import curves as C
from mvtrack.operators import gaps, labelling, reconstruction, tables

WATER, TS, PAD, W, H = 0.75, [0.0, 0.25, 0.5, 0.75, 1.0], 12.0, 128, 64
TANK = {"diameter": 2.0, "water_z": WATER, "resolution": 0.1}
CURVES = "frame_idx long, fish_id long, control array<double>, n_cameras long, mean_residual double, per_camera map<string,double>"
RIG = "camera_id string, fx double, fy double, cx double, cy double, px double, py double, pz double, width int, height int"


def _rig():
    return [(f"c{k}", 1400.0, 1390.0, 800.0, 600.0, 0.3 * (k % 3) - 0.3, 0.3 * (k // 3) - 0.15, 0.0, 1600, 1200) for k in range(6)]


def _fish(n, seed=3):
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        start, way = rng.uniform([-0.5, -0.4, 0.85], [0.5, 0.4, 1.2]), rng.uniform(-0.06, 0.06, 3) * [1, 1, 0.2]
        control = start + np.arange(7)[:, None] * way + rng.normal(0, 0.01, (7, 3))
        own = {f"c{c}": float(rng.uniform(0, 20)) for c in range(6) if (k + c) % 2 == 0 and (k % 4 or c < 3)}
        out.append((k // 3, k, control.ravel().tolist(), len(own), float(np.mean(list(own.values()))), own))
    return out


def _box(points):
    middle = points.mean(0)
    axis = np.linalg.svd(points - middle, full_matrices=False)[2][0]
    axis = axis if axis[0] > 0 else -axis
    across = np.array([-axis[1], axis[0]])
    reach = np.abs((points - middle) @ axis).max() + 2
    return np.array([middle + a * reach * axis + b * PAD * across for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])


def _plain(curves):
    """{(fish, camera): (source, points, seen, box, confidence)} of all labels."""
    rig = {r[0]: np.array(r[1:8]) for r in _rig()}
    middle = np.mean([[r[5], r[6]] for r in _rig()], axis=0)
    weights, out = np.array([C.basis(t) for t in TS]), {}
    for _, fish, control, n, mean, per in curves:
        control = np.array(control).reshape(7, 3)
        centre = control.mean(0)
        voxel = np.rint((centre - [*(middle - 1.1), WATER]) / 0.1) * 0.1 + [*(middle - 1.1), WATER]
        for camera, lens in rig.items():
            u, v = reconstruction.project(voxel, lens, WATER)
            if camera in per:
                if per[camera] > 15:
                    continue
                source = "consensus"
            elif len(per) >= 3 and 0 <= u < 1600 and 0 <= v < 1200:
                source = "gap"
            else:
                continue
            points = reconstruction.project(weights @ control, lens, WATER)
            seen = (points >= 0).all(1) & (points < [1600, 1200]).all(1)
            if seen.sum() >= 2:
                score = 0.5 * max(0, 1 - mean / 10) + 0.3 * min(1, max(0, (n - 2) / 6)) + 0.2 * max(0, 1 - np.var(list(per.values())) / 25)
                out[fish, camera] = (source, points, seen, _box(points[seen]), score)
    return out


@pytest.fixture
def made(spark):
    rig = spark.createDataFrame(_rig(), RIG)
    table = tables.inverse_table(tables.voxel_grid(spark, rig, height=1.0, **TANK), rig, WATER)
    curves = labelling.described(spark.createDataFrame(_fish(24), CURVES))
    boxes = spark.createDataFrame([(k // 3, f"c{c}", 0.0, 0.0, 900.0, 1200.0) for k in range(24) for c in (0, 1, 2)], "frame_idx long, camera_id string, x double, y double, w double, h double")
    tracks = spark.createDataFrame([(f, f"c{c}", "detected") for f in range(8) for c in range(2) for _ in range(2)], "frame_idx long, camera_id string, status string")
    missed = labelling.gap_views(curves, rig, table, boxes, tracks, TANK)
    return labelling.labels(curves, rig, TS, WATER, missed, PAD), tracks, (curves, rig, table, boxes)


def test_labels_equal_the_plain_ones(made):
    got, want = made[0].collect(), _plain(_fish(24))
    assert {(r.fish_id, r.camera_id) for r in got} == set(want) and len(got) == len(want)
    assert {r.source for r in got} == {"consensus", "gap"} and {r.reason for r in got} >= {None, "no-detection", "no-tracklet", "failed-midline"}
    for r in got:
        source, points, seen, box, score = want[r.fish_id, r.camera_id]
        assert (r.source, r.n_visible, r.posed) == (source, seen.sum(), bool(seen.sum() >= 2)) and (r.reason is None) == (source == "consensus")
        assert [p.seen for p in r.points] == seen.tolist() and np.allclose([(p.x, p.y) for p in r.points], points, atol=1e-6)
        line = np.array(r.obb_line.split(" "), float)
        assert line[0] == 0 and np.allclose(line[1:].reshape(4, 2) * [1600, 1200], box, atol=2e-3)
        assert abs(r.confidence - score) < 1e-9


def test_images_are_complete_when_all_tracks_are_labelled(made):
    labelled, tracks, _ = made
    want = {}
    for fish, camera in _plain(_fish(24)):
        want.setdefault((fish // 3, camera), []).append(fish)
    got = labelling.images(labelled, tracks).collect()
    assert {(r.frame_idx, r.camera_id): r.n_labels for r in got} == {k: len(v) for k, v in want.items()}
    for r in got:
        assert r.n_tracked == (2 if r.camera_id in ("c0", "c1") else 0) and r.complete == (r.n_labels >= r.n_tracked)
        report = json.loads(r.report)
        assert [x["fish_id"] for x in report["labels"]] == sorted(want[r.frame_idx, r.camera_id]) and len(r.lines.split("\n")) == r.n_labels and r.image == f"{r.frame_idx:06d}_{r.camera_id}"
    one = labelling.summary(labelled, labelling.images(labelled, tracks)).first()
    whole = [r for r in got if r.complete]
    assert one.skipped == len(got) - len(whole) > 0 and one.images == len(whole) and one.labels == sum(r.n_labels for r in whole)
    assert abs(one.mean_confidence - np.average([r.confidence for r in whole], weights=[r.n_labels for r in whole])) < 1e-9


def test_crops_hold_all_fish_that_show(made):
    plain = _plain(_fish(24))
    want = {}
    for (fish, camera), (source, _, _, box, _) in plain.items():
        near = sorted(f for (f, c), p in plain.items() if f // 3 == fish // 3 and c == camera and p[0] == source)
        lines = []
        for other in near:
            _, points, seen, _, _ = plain[other, camera]
            sides = np.array([box[1] - box[0], box[3] - box[0]])
            moved = (points - box[0]) @ (sides / (sides**2).sum(1)[:, None]).T * [W - 1, H - 1]
            shows = seen & (moved >= 0).all(1) & (moved < [W, H]).all(1)
            if shows.sum() >= 2:
                moved = np.clip(moved, 0, [W - 1, H - 1])
                small = np.clip(_box(moved[shows]), 0, [W - 1, H - 1])
                low, high = small.min(0), small.max(0)
                cells = [0, *((low + high) / 2 / [W, H]), *((high - low) / [W, H])]
                for p, s in zip(moved, shows):
                    cells += [*(p / [W, H]), 2] if s else [0, 0, 0]
                lines.append(cells)
        if lines:
            want[fish, camera] = (near.index(fish), lines)
    got = {(r.fish_id, r.camera_id): r for r in labelling.crops(made[0], W, H, PAD).collect()}
    assert set(got) == set(want) and any(len(w[1]) > 1 for w in want.values())
    for k, (number, lines) in want.items():
        mine = [np.array(line.split(" "), float) for line in got[k].lines.split("\n")]
        assert got[k].crop == number and got[k].image == f"{k[0] // 3:06d}_{k[1]}_{number:03d}" and got[k].n_lines == len(lines)
        assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(mine, lines, strict=True))


def test_steps_nulls_and_empty_tables(spark, made):
    _, tracks, (curves, rig, table, boxes) = made
    every = spark.createDataFrame([*_fish(6), (9, 99, _fish(1)[0][2], 0, 0.0, {})], CURVES)
    stepped = labelling.described(every, step=2)
    assert {r.frame_idx for r in stepped.collect()} == {0}
    alone = labelling.labels(labelling.described(every), rig, TS, WATER, None, PAD)
    assert {r.source for r in alone.collect()} == {"consensus"} and 99 not in {r.fish_id for r in alone.collect()}
    none = labelling.described(spark.createDataFrame([], CURVES))
    nothing = labelling.labels(none, rig, TS, WATER, labelling.gap_views(none, rig, table, boxes, tracks, TANK), PAD)
    assert nothing.count() == 0 and labelling.crops(nothing).count() == 0
    one = labelling.summary(nothing, labelling.images(nothing, tracks)).first()
    assert tuple(one) == (0, 0, 0.0, 0, 0, 0)
    bare = labelling.gap_views(curves, rig.limit(0), table, boxes, tracks, TANK)
    assert bare.count() == 0
    point = spark.createDataFrame([(1, 0, "c0", None, None)], "id long, frame_idx long, camera_id string, u double, v double")
    assert [r.reason for r in gaps.reasons(point, boxes, tracks, ["id"]).select(F.col("reason")).collect()] == ["no-detection"]
