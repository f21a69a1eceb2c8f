import hashlib
import math

import numpy as np
import pytest

from mvtrack.llm import centroid_clusters as C


def plain(rows, k, rounds, dims):
    """The definition with Python's integers; rows of (vec_id, embedding)."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    by_hash = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in by_hash[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [place(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, own) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    placed = [place(v) for _, v in kept]
    sums = [sum(d for d, c in placed if c == n) for n in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sums[c], sum(sums), sha[c]) for (i, _), (d, c) in zip(kept, placed)), key=str)


SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], SCHEMA).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("scale", [0.001, 0.02, 1.0, 50_000.0])
def test_equals_the_definition(spark, scale):
    """Small scales give many ties, large ones products far beyond float32's integers."""
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * scale).clip(-520_000, 520_000).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[i][1]) for i in range(0, 40, 2)] + [(1000 + i, rows[5][1]) for i in range(50)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 7), (2003, [1.0] * 9), (2004, [1.0] * 7 + [None]), (2005, [math.nan] + [0.0] * 7), (2006, [math.inf] + [0.0] * 7), (None, rows[7][1]), (None, rows[8][1])]
    assert got(C.clusters(frame(spark, rows), k=12, rounds=4, dims=8)) == plain(rows, 12, 4, 8)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(i, [float(i), 0.0]) for i in range(3)]
    assert got(C.clusters(frame(spark, rows), k=5, rounds=2, dims=2)) == plain(rows, 5, 2, 2)
    for some in ([], [(1, None)]):
        assert C.clusters(frame(spark, some) if some else spark.createDataFrame([], SCHEMA), k=5, dims=2).collect() == []


def test_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="larger than"):
        C.clusters(frame(spark, [(1, [1e9, 0.0])]), k=1, dims=2).collect()


def test_screening_never_changes_the_nearest(monkeypatch):
    """Centroids a rounding apart: float32 alone gets many wrong, intervals none; exact pairs in slices."""
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 26), 1 << 26, 64)
    centroids = base + rng.integers(-3, 4, (40, 64))
    points = np.concatenate((base + rng.integers(-9, 10, (500, 64)), rng.integers(-(1 << 26), 1 << 26, (50, 64)), centroids[::-1]))
    want = (((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)).argmin(axis=1)
    float32 = ((centroids.astype(np.float32) ** 2).sum(axis=1) - 2 * points.astype(np.float32) @ centroids.astype(np.float32).T).argmin(axis=1)
    assert (float32 != want).any()
    for pairs in (65_536, 100):
        monkeypatch.setattr(C, "_PAIRS", pairs)
        assert (C.nearest(points, centroids) == want).all()


def test_equal_centroids_take_the_smaller_number():
    centroids = np.array([[5, 5], [1, 1], [1, 1], [5, 5]])
    assert C.nearest(np.array([[1, 1], [5, 5], [3, 3]]), centroids).tolist() == [1, 0, 0]
