"""The longest path through the thin lines of objects: their pixels as graphs of eight neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def neighbours(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(n, 8) places of each pixel's neighbours among pixels in order of (y, x), -1 where there is none."""
    wide = int(x.max() - x.min()) + 3 if len(x) else 3
    code = (y - y.min()) * wide + (x - x.min()) + 1 if len(x) else np.zeros(0, np.int64)
    out = np.full((len(code), 8), -1)
    for k, (dy, dx) in enumerate(_AROUND):
        want = code + dy * wide + dx
        at = np.minimum(np.searchsorted(code, want), len(code) - 1)
        out[:, k] = np.where(code[at] == want, at, -1)
    return out


def steps_from(near: np.ndarray, start: int) -> np.ndarray:
    """Steps to each pixel from one, -1 where there is no way: a frontier at a time."""
    steps = np.full(len(near), -1)
    steps[start] = 0
    front, n = np.array([start]), 0
    while len(front):
        n += 1
        ahead = np.unique(near[front])
        front = ahead[(ahead >= 0) & (steps[ahead] < 0)]
        steps[front] = n
    return steps


def longest_path(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of a path in order, among pixels in order of (y, x): from the farthest pixel of the first one's part to the farthest from that.

    Of equally far ones the first by (y, x), and so at each step back.  Exact where
    lines have no loops.
    """
    if not len(y):
        return np.zeros(0, np.int64)
    near = neighbours(y, x)
    one = int(steps_from(near, 0).argmax())
    steps = steps_from(near, one)
    path = [int(steps.argmax())]
    while steps[path[-1]]:
        back = near[path[-1]]
        path.append(int(min(b for b in back if b >= 0 and steps[b] == steps[path[-1]] - 1)))
    return np.array(path[::-1])


def longest_paths(pixels: DataFrame) -> DataFrame:
    """(object, i, y, x): the longest path of each object of ``pixels`` (object, y, x).

    An object is a group, bounded by the pixels of an image, as its mask was.
    Repeated pixels count once, null ones not; of several parts the one with the
    first pixel is taken.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("y", "ascending"), ("x", "ascending")])
        y, x = (rows.column(c).to_numpy().astype(np.int64) for c in "yx")
        path = longest_path(y, x)
        cells = [rows.column("object").take(pa.array(path)), pa.array(np.arange(len(path))), pa.array(y[path]), pa.array(x[path])]
        return pa.Table.from_arrays(cells, names=["object", "i", "y", "x"])

    own = pixels.select(F.col("object").cast("long").alias("object"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).dropna(subset=["y", "x"]).distinct()
    return own.groupBy("object").applyInArrow(run, "object long, i long, y long, x long")
