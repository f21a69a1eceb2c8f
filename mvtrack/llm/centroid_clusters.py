"""Operator 13: centroid clustering in exact integers, screened by float32 products.

A vector of x becomes integers floor(256 x).  A round assigns every vector to the
nearest centroid by squared distance, the smaller number on ties, and replaces
each centroid that has vectors by their componentwise floor(sum / count).

Screening.  Of |v - c|^2 only |c|^2 - 2 v.c depends on the centroid.  All products
of a batch are one float32 matrix product; whatever the order of its sums, its
error is at most g |v| |c|, g = (d + 2) u / (1 - (d + 2) u), u = 2^-24, over d
components, two of the roundings being those of v and c to float32 (Cauchy and
Schwarz bound the sum of |v_i c_i|).  With the roundings of the float64 steps
around it, that gives an interval for each centroid.  A centroid whose interval
begins above the least end cannot be nearest.  Where more than one is left, their
distances are computed again in int64, exactly, and the least, then lowest, wins.

A round is one pass over the vectors that returns a row of sums a cluster and
task; the centroids, k rows of d integers, are all that the driver holds.

Cases.  A vector counts if it has exactly ``dims`` components, none null or not
finite; a null vector does not.  Null ids are allowed, and come last among the
hashes that choose the first centroids; rows that repeat an id are vectors of
their own, ordered by their components.  With fewer vectors than ``k`` there are
as many centroids.  Components beyond 2^27 in size are an error, as squared
distances must fit 64 bits, as must their sums in the result.  No vectors give no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

DIMS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
#: Largest integer component: differences of 2^28 in 64 components have a squared distance of 2^62.
LARGEST = 1 << 27
_PAIRS = 65_536  # exact distances computed at a time


def vectors(batch: pa.RecordBatch, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of a batch that count, and their integers."""
    cells = batch.column("embedding")
    sizes = np.asarray(cells.value_lengths().fill_null(-1))
    at = np.flatnonzero(sizes == dims)
    flat = cells.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    good = np.isfinite(flat).all(axis=1)  # a null component became NaN
    whole = np.floor(SCALE * flat[good])
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a component is larger than {LARGEST} / {SCALE}")
    return at[good], whole.astype(np.int64)


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each point; exact, ties to the smaller number."""
    dims = points.shape[1]
    steps = (dims + 2) * 2.0**-24
    slack = steps / (1 - steps) * (1 + 2.0**-40)
    own = np.sqrt(np.einsum("ij,ij->i", points, points).astype(np.float64)) * (1 + 2.0**-50)
    square = np.einsum("ij,ij->i", centroids, centroids).astype(np.float64)
    length = np.sqrt(square) * (1 + 2.0**-50)
    dot = (points.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    score = square[None, :] - 2 * dot
    radius = 2 * slack * own[:, None] * length[None, :] + 2.0**-48 * (square[None, :] + 2 * np.abs(dot))
    near = score - radius <= (score + radius).min(axis=1, keepdims=True)
    chosen = near.argmax(axis=1)
    for rows in np.array_split(open_ := np.flatnonzero(near.sum(axis=1) > 1), 1 + len(open_) * len(centroids) // _PAIRS):
        if not len(rows):
            continue
        row, number = np.nonzero(near[rows])
        gap = points[rows[row]] - centroids[number]
        exact = np.einsum("ij,ij->i", gap, gap)
        starts = np.searchsorted(row, np.arange(len(rows)))
        best = exact == np.repeat(np.minimum.reduceat(exact, starts), np.diff(np.append(starts, len(row))))
        winners, first = np.unique(row[best], return_index=True)
        chosen[rows[winners]] = number[best][first]
    return chosen


def _first(embeddings: DataFrame, k: int, dims: int, salt: str) -> np.ndarray:
    """The k vectors of least hash: each task's least k go on, and of those the least."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in batches:
            at, whole = vectors(batch, dims)
            ids = batch.column("vec_id").take(pa.array(at)).to_pylist()
            hashes = [(1, "") if i is None else (0, hashlib.sha256(f"{salt}{i}".encode()).hexdigest()) for i in ids]
            order = sorted(range(len(ids)), key=hashes.__getitem__)[:k]
            last = hashes[order[-1]] if order else None
            best = sorted(best + [(*hashes[j], whole[j].tolist()) for j in range(len(ids)) if hashes[j] <= last])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([b[c] for b in best], t) for c, t in enumerate((pa.int32(), pa.string(), pa.list_(pa.int64())))], names=["late", "hash", "v"])

    least = small_batches(embeddings.select("vec_id", "embedding")).mapInArrow(keep, "late int, hash string, v array<long>").orderBy("late", "hash", "v").limit(k)
    return np.array([r.v for r in least.collect()], np.int64).reshape(-1, dims)


def _sums(embeddings: DataFrame, centroids: np.ndarray, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that has vectors, their number and the sums of their components."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), dims), object), np.zeros(len(centroids), np.int64)  # Python's integers don't overflow
        for batch in batches:
            _, whole = vectors(batch, dims)
            chosen = nearest(whole, centroids)
            order = np.argsort(chosen, kind="stable")
            own, starts = np.unique(chosen[order], return_index=True)
            if len(own):
                sums[own] += np.add.reduceat(whole[order], starts, axis=0)
                counts += np.bincount(chosen, minlength=len(centroids))
        own = np.flatnonzero(counts)
        cells = [pa.array(own.astype(np.int32)), pa.array(counts[own]), pa.array([[str(x) for x in s] for s in sums[own]], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(cells, names=["cluster", "n", "s"])

    part = small_batches(embeddings.select("embedding")).mapInArrow(add, "cluster int, n long, s array<string>")
    total = part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i].cast("decimal(30,0)")).alias(f"s{i}") for i in range(dims)])
    return {r[0]: (r[1], [int(x) for x in r[2:]]) for r in total.collect()}  # k rows at most


def fit(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, salt: str = "2:") -> np.ndarray:
    """The centroids after so many rounds, at most k rows of ``dims`` integers."""
    centroids = _first(embeddings, k, dims, salt)
    for _ in range(rounds if len(centroids) else 0):
        for number, (n, sums) in _sums(embeddings, centroids, dims).items():
            centroids[number] = [s // n for s in sums]
    return centroids


def assign(embeddings: DataFrame, centroids: np.ndarray, dims: int = DIMS) -> DataFrame:
    """(vec_id, cluster, distance) for each vector that counts."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, whole = vectors(batch, dims)
            if not len(at) or not len(centroids):
                continue
            chosen = nearest(whole, centroids)
            gap = whole - centroids[chosen]
            cells = [batch.column("vec_id").take(pa.array(at)), pa.array(chosen.astype(np.int32)), pa.array(np.einsum("ij,ij->i", gap, gap))]
            yield pa.RecordBatch.from_arrays(cells, names=["vec_id", "cluster", "distance"])

    ids = embeddings.schema["vec_id"].dataType.simpleString()
    return small_batches(embeddings.select("vec_id", "embedding")).mapInArrow(place, f"vec_id {ids}, cluster int, distance long")


def clusters(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, salt: str = "2:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row a vector that counts."""
    centroids = fit(embeddings, k, rounds, dims, salt)
    placed = table(assign(embeddings, centroids, dims))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = embeddings.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    by_cluster = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d"))
    total = by_cluster.agg(F.sum("d").cast("long").alias("inertia"))
    sums = by_cluster.join(named, "cluster").join(F.broadcast(total)).select("cluster", F.col("d").cast("long").alias("cluster_inertia"), "inertia", "centroid_sha256")
    return placed.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
