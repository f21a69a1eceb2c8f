"""Orientation of midlines against a plain loop over frames."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mvtrack.operators import orientation

TRACKS = "fish_id long, camera_id string, track_id long, frame_idx long, u double, v double"
MIDLINES = "frame_idx long, camera_id string, det_idx long, u double, v double, points array<struct<u:double,v:double>>"


def test_carried_equals_a_fold(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), k, float(rng.choice([-0.5, -0.3, -0.1, 0.0, 0.1, 0.3, 0.5]))) for g in range(6) for k in range(200)]
    w = Window.partitionBy("g").orderBy("k")
    got = {(r.g, r.k): r.o for r in spark.createDataFrame(rows, "g long, k long, v double").withColumn("o", orientation.carried(F.col("v"), 0.3, w)).collect()}
    before = {}
    for g, k, v in rows:
        before[g] = 1 if v + 0.3 * before.get(g, 0) >= 0 else -1
        assert got[g, k] == before[g]


def _scene(seed):
    rng, tracks, midlines = np.random.default_rng(seed), [], []
    for fish in range(3):
        at = rng.uniform(0, 500, 2)
        for frame in range(60):
            at = at + rng.normal(0, 4, 2)
            for c in range(3):
                if rng.random() < 0.45:
                    tracks.append((fish, f"c{c}", 10 * fish + int(rng.integers(0, 2)), frame, *map(float, at + 40 * c + rng.normal(0, 1, 2))))
                    if rng.random() < 0.8:
                        place = at + 40 * c + rng.normal(0, 4, 2)
                        line = None if rng.random() < 0.2 else [tuple(map(float, place + rng.normal(0, 20, 2))) for _ in range(4)]
                        midlines.append((frame, f"c{c}", fish, *map(float, place), line))
    return tracks, midlines


def _plain(tracks, midlines, speed=2.0):
    out, before = {}, {}
    at = {}
    for fish, camera, track, frame, u, v in sorted(tracks, key=lambda t: t[3]):
        at.setdefault((fish, camera, track), {})[frame] = (u, v)
    for frame in sorted({t[3] for t in tracks}):
        for fish in sorted({t[0] for t in tracks}):
            lines, move = {}, None
            for (f, camera, track), places in sorted(at.items()):
                dets = [m for m in midlines if m[0] == frame and m[1] == camera]
                if f != fish or frame not in places or not dets:
                    continue
                u, v = places[frame]
                far = [(float(np.hypot(m[3] - u, m[4] - v)), m[2], m) for m in dets]
                best = min((x for x in far if x[0] < 10), default=None, key=lambda x: x[:2])
                if best is not None and best[2][5] is not None:
                    lines[camera] = best[2]
                past = [g for g in places if g < frame]
                if move is None and past:
                    p = places[max(past)]
                    move = np.array([u - p[0], v - p[1]])
            if not lines:
                continue
            total = 1.0 if len(lines) >= 2 else 0.0
            head = np.array(lines[min(lines)][5][0]) - lines[min(lines)][5][-1]
            if move is not None and np.hypot(*move) >= speed:
                total += 0.5 if head @ move > 0 else -0.5
            before[fish] = 1 if total + 0.3 * before.get(fish, 0) >= 0 else -1
            for camera, m in lines.items():
                out[fish, frame, camera] = (m[2], before[fish], m[5] if before[fish] == 1 else m[5][::-1])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_oriented_equals_the_plain_loop(spark, seed):
    tracks, midlines = _scene(seed)
    got = orientation.oriented(spark.createDataFrame(tracks, TRACKS), spark.createDataFrame(midlines, MIDLINES)).collect()
    want = _plain(tracks, midlines)
    assert {(r.fish_id, r.frame_idx, r.camera_id) for r in got} == set(want) and len(got) == len(want)
    assert {w[1] for w in want.values()} == {1, -1}
    for r in got:
        det, sign, points = want[r.fish_id, r.frame_idx, r.camera_id]
        assert (r.det_idx, r.orientation) == (det, sign) and np.allclose([(p.u, p.v) for p in r.points], points)


def test_nothing_gives_nothing(spark):
    tracks, midlines = _scene(1)
    some, none = spark.createDataFrame(tracks, TRACKS), spark.createDataFrame([], MIDLINES)
    assert orientation.oriented(some, none).count() == 0 and orientation.oriented(some.limit(0), spark.createDataFrame(midlines, MIDLINES)).count() == 0
