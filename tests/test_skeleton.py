import numpy as np

from mvtrack.operators import gaps, skeleton


def plain_steps(pixels, start):
    """Breadth first over a set of pixels."""
    steps, todo = {start: 0}, [start]
    for p in todo:
        for q in sorted((p[0] + dy, p[1] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
            if q in pixels and q not in steps:
                steps[q] = steps[p] + 1
                todo.append(q)
    return steps


def far(steps):
    most = max(steps.values())
    return min(p for p in steps if steps[p] == most)


def drawn(rng, n):
    """A bent line of pixels, some with a branch."""
    at, way, out = np.zeros(2), rng.uniform(0, 6), []
    for k in range(n):
        way += rng.normal() * 0.2
        at = at + [np.sin(way), np.cos(way)]
        out.append(tuple(np.round(at).astype(int).tolist()))
        if k == n // 2 and rng.random() < 0.5:
            out += [tuple(np.round(at + [j, -j]).astype(int).tolist()) for j in range(n // 4)]
    return out


def test_paths_of_drawn_lines(spark):
    rng = np.random.default_rng(1)
    objects = {k: drawn(rng, int(rng.integers(1, 80))) for k in range(40)}
    objects[40] = [(0, 0), (0, 1), (50, 50), (50, 51), (50, 52)]  # two parts
    rows = [(k, y, x) for k, pixels in objects.items() for y, x in pixels] + [(7, None, 1)]
    got = {}
    for r in skeleton.longest_paths(spark.createDataFrame(rows, "object long, y long, x long")).orderBy("object", "i").collect():
        got.setdefault(r.object, []).append((r.y, r.x))
    assert got.keys() == objects.keys()
    for k, pixels in objects.items():
        own = set(pixels)
        one = far(plain_steps(own, min(own)))
        steps = plain_steps(own, one)
        assert got[k][0] == one and got[k][-1] == far(steps) and len(got[k]) == max(steps.values()) + 1 and len(set(got[k])) == len(got[k])
        assert all(p in own and max(abs(p[0] - q[0]), abs(p[1] - q[1])) <= 1 for p, q in zip(got[k], got[k][1:], strict=False))


def test_a_line_without_loops_has_its_longest_path():
    """Against all pairs."""
    tee = {(0, x) for x in range(9)} | {(y, 4) for y in range(2, 12)} | {(1, 4)}
    pixels = np.array(sorted(tee))
    best = max(max(plain_steps(tee, p).values()) for p in tee)
    assert len(skeleton.longest_path(pixels[:, 0], pixels[:, 1])) == best + 1


def test_no_pixels(spark):
    assert skeleton.longest_paths(spark.createDataFrame([], "object long, y long, x long")).collect() == []
    assert len(skeleton.longest_path(np.zeros(0, int), np.zeros(0, int))) == 0


def test_reasons_of_gaps(spark):
    points = spark.createDataFrame([(1, 0, "a", 5.0, 5.0), (2, 0, "a", 50.0, 5.0), (3, 0, "a", None, None), (4, 1, "a", 10.0, 10.0), (5, 1, "b", 5.0, 5.0)], "id long, frame_idx long, camera_id string, u double, v double")
    boxes = spark.createDataFrame([(0, "a", 0.0, 0.0, 10.0, 10.0), (0, "a", 2.0, 2.0, 10.0, 10.0), (1, "a", 0.0, 0.0, 10.0, 10.0)], "frame_idx long, camera_id string, x double, y double, w double, h double")
    tracks = spark.createDataFrame([(0, "a", "detected"), (1, "a", "coasted"), (0, "a", "detected")], "frame_idx long, camera_id string, status string")
    got = {r.id: r.reason for r in gaps.reasons(points, boxes, tracks).collect()}
    assert got == {1: "failed-midline", 2: "no-detection", 3: "no-detection", 4: "no-tracklet", 5: "no-detection"}
