"""Nearest boxes by cells, against the distances to all boxes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mvtrack.operators import matching
from mvtrack.plans import queries as Q


def plain(px, py, box, tie, tolerance, inclusive):
    """As the SQL has it: all distances, then the least, then the least tie."""
    d = np.sqrt((px[:, None] - box[0] - box[2] / 2) ** 2 + (py[:, None] - box[1] - box[3] / 2) ** 2)
    out = []
    for row in d:
        k = np.lexsort((tie, row))[0]
        out.append((k, row[k]) if (row[k] <= tolerance if inclusive else row[k] < tolerance) else (-1, None))
    return out


@pytest.mark.parametrize("tolerance", [0.5, 10, 200, 5000])
def test_nearest_equals_all_distances(monkeypatch, tolerance):
    monkeypatch.setattr(matching, "_PAIRS", 50)
    rng = np.random.default_rng(int(tolerance))
    for case in range(30):
        n, m = rng.integers(1, 60), rng.integers(1, 200)
        wide = (20, 1000)[case % 2]  # dense grids have many ties
        box = np.array([rng.integers(0, wide, m), rng.integers(0, wide, m), rng.integers(1, 4, m), rng.integers(1, 4, m)], float)
        if case % 5 == 0:
            box[:2, : m // 2] = 7.0
            box[:2, -1] = 1e12  # one far away, and many in one place
        px, py = (rng.integers(-20, wide * 2 + 20, n) / 2 for _ in "xy")
        tie = rng.permutation(m) * (-1 if case % 3 else 1)
        found, dist = matching._nearest(px, py, box, tie, tolerance, case % 2 == 0)
        for (k, d), f, g in zip(plain(px, py, box, tie, tolerance, case % 2 == 0), found, dist, strict=True):
            assert k == f and (k < 0 or d == g)


def test_points_look_at_the_boxes_around_them(monkeypatch):
    """10,000 points among 20,000 boxes: 200,000,000 distances before, some 30 a point now."""
    rng, seen = np.random.default_rng(8), []
    portions = matching._portions
    monkeypatch.setattr(matching, "_portions", lambda counts: seen.append(int(counts.sum())) or portions(counts))
    box = np.array([rng.uniform(0, 1600, 20_000), rng.uniform(0, 1200, 20_000), np.full(20_000, 9.0), np.full(20_000, 5.0)])
    found, _ = matching._nearest(rng.uniform(0, 1600, 10_000), rng.uniform(0, 1200, 10_000), box, np.arange(20_000), 200, False)
    assert (found >= 0).all() and sum(seen) < 600_000


def test_odd_points_and_boxes(spark):
    """No place, no camera, a point that comes twice, and ties under both rules."""
    boxes = spark.createDataFrame([(0, "a", 0, 0.0, 0.0, 2.0, 2.0), (0, "a", 1, 0.0, 0.0, 2.0, 2.0), (0, "a", 2, None, 0.0, 2.0, 2.0), (0, None, 0, 0.0, 0.0, 2.0, 2.0), (1, "a", 0, float("nan"), 0.0, 2.0, 2.0)], "frame_idx long, camera_id string, det_idx long, x double, y double, w double, h double")
    points = spark.createDataFrame([(0, "a", 1, 1.0, 1.0), (0, "a", 2, 9.0, 1.0), (0, "a", 2, 4.0, 1.0), (0, "a", 3, None, 1.0), (0, "a", 4, float("nan"), 1.0), (0, None, 5, 1.0, 1.0), (1, "a", 6, 1.0, 1.0), (2, "a", 7, 1.0, 1.0)], "frame_idx long, camera_id string, point_id long, px double, py double")
    for last, det in ((False, 0), (True, 1)):
        got = sorted((r.point_id, r.det_idx, r.dist) for r in matching.nearest(points, boxes, 8, True, last).collect())
        assert got == [(1, det, 0.0), (2, det, 3.0)]


def test_referenced_boxes_are_read_once(spark):
    plan = Q.QUERIES["p3_referenced_detections"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_quantity") and plan.count("Relation") == 2
