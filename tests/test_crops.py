import numpy as np

from mvtrack.operators import matching


def test_all_centres_in_each_crop(spark, monkeypatch):
    """Against all pairs of an image, in small portions; borders are inclusive, and boxes without a place are in no crop."""
    monkeypatch.setattr(matching, "_PAIRS", 100)
    rng = np.random.default_rng(3)
    rows = [(f, c, d, *(float(v) for v in rng.integers(0, 60, 2)), *(float(v) for v in rng.integers(1, 9, 2)), f"{c}{f}") for f in range(2) for c in "ab" for d in range(150)]
    odd = [(0, "a", 900, None, 1.0, 1.0, 1.0, "a0"), (0, "a", 901, 1.0, float("nan"), 1.0, 1.0, "a0"), (0, None, 902, 1.0, 1.0, 1.0, 1.0, "")]
    boxes = spark.createDataFrame(rows + odd, "frame_idx long, camera_id string, det_idx long, x double, y double, w double, h double, split string").repartition(5)
    found = matching.in_crops(boxes, 3.0, ["split"])
    got = sorted(map(tuple, found.collect()))
    want = sorted(
        (f, c, d, e, s)
        for f, c, d, x, y, w, h, s in rows
        for g, k, e, x2, y2, w2, h2, _ in rows
        if (f, c) == (g, k) and x - 3 <= x2 + w2 / 2 <= x + w + 3 and y - 3 <= y2 + h2 / 2 <= y + h + 3
    )
    assert got == want and len(want) > 3000
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_windows_look_at_their_bands(monkeypatch):
    """Of 16,000,000 pairs of an image the 24,000 or so that lie in small windows, and few others, are looked at."""
    rng, seen = np.random.default_rng(4), []
    portions = matching._portions
    monkeypatch.setattr(matching, "_portions", lambda counts: seen.append(int(counts.sum())) or portions(counts))
    x, y = rng.uniform(0, 1000, (2, 4000))
    n = sum(len(a) for a, _ in matching._in_windows(x - 10, x + 10, y - 10, y + 10, x, y))
    assert n == int(((abs(x[:, None] - x) <= 10) & (abs(y[:, None] - y) <= 10)).sum()) and sum(seen) < 5 * n
