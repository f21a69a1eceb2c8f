"""Joins with a tolerance, and the scoring of pairs across cameras.

Every distance join is an equi-join on frame and camera with the distance as a
filter on its output, never a cross join; tracks that meet in frames are paired in
blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from . import blocks

#: Distances of the columns of two sides, which come as arrays that broadcast against each other.
Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Frames of a table of who is there; cells of a grid from its origin; pairs of points and boxes at once.
_FRAMES, _FAR, _PAIRS = 4096, 1 << 29, 2_000_000


def _nearest(px: np.ndarray, py: np.ndarray, box: np.ndarray, tie: np.ndarray, tolerance: float, inclusive: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each point the place of its box (x, y, w, h), or -1, and its distance: the nearest, then the least ``tie``.

    Boxes are sorted into square cells of a few boxes.  A point looks through the
    cells within a distance that doubles until its nearest box is within it.
    """
    order = np.lexsort((tie, *box))
    order = order[np.r_[True, (box[:, order[1:]] != box[:, order[:-1]]).any(axis=0)]] if len(order) else order  # of equal boxes only one can win
    best, found = np.full(len(px), np.inf), np.full(len(px), -1)
    if not len(order):
        return found, best
    box, tie = box[:, order], tie[order]
    bx, by = box[0] + box[2] / 2, box[1] + box[3] / 2
    spread = [np.subtract(*np.quantile(c, (0.9, 0.1))) for c in (bx, by)]
    side = min(max(np.sqrt(max(spread[0] * spread[1], 0) * 3 / len(bx)), max(spread) / 1000, tolerance / 64, 1e-9), max(tolerance, 1e-9))
    cell = lambda c: np.clip(np.floor(c / side), -_FAR, _FAR).astype(np.int64)
    rows = np.argsort(cell(by) * (4 * _FAR) + cell(bx), kind="stable")
    box, tie, order = box[:, rows], tie[rows], order[rows]
    keys = cell(by[rows]) * (4 * _FAR) + cell(bx[rows])
    left, within = np.arange(len(px)), side
    while len(left):
        within = min(within, tolerance)
        reach = within * (1 + 1e-9)
        x0, x1, y0, y1 = (cell(c[left] + s * reach) for c in (px, py) for s in (-1, 1))
        for up in range(int((y1 - y0).max()) + 1):
            band = np.flatnonzero(y0 + up <= y1)
            at = (y0[band] + up) * (4 * _FAR)
            low, high = np.searchsorted(keys, at + x0[band]), np.searchsorted(keys, at + x1[band], "right")
            for part in _portions(high - low):
                n = high[part] - low[part]
                ends = np.cumsum(n)
                if not len(n) or not ends[-1]:
                    continue
                own = left[band[part]]
                b = np.arange(ends[-1]) + np.repeat(low[part] - ends + n, n)
                d = np.sqrt((np.repeat(px[own], n) - box[0, b] - box[2, b] / 2) ** 2 + (np.repeat(py[own], n) - box[1, b] - box[3, b] / 2) ** 2)
                some = n > 0
                starts = (ends - n)[some]
                least = np.minimum.reduceat(d, starts)
                ties = np.where(d == np.repeat(least, n[some]), tie[b], np.iinfo(np.int64).max)
                first = np.minimum.reduceat(ties, starts)
                spot = np.minimum.reduceat(np.where(ties == np.repeat(first, n[some]), b, len(keys)), starts)
                p = own[some]
                old = np.where(found[p] >= 0, tie[found[p]], np.iinfo(np.int64).max)
                wins = (least < best[p]) | ((least == best[p]) & (first < old))
                best[p[wins]], found[p[wins]] = least[wins], spot[wins]
        if within >= tolerance:
            break
        left = left[best[left] > within]
        within *= 2
    kept = (best <= tolerance) if inclusive else (best < tolerance)
    return np.where(kept & (found >= 0), order[found], -1), best


def _portions(counts: np.ndarray) -> list[slice]:
    """Stretches of at most about two million in sum; a larger one by itself."""
    ends = np.cumsum(counts)
    cuts = [0]
    while cuts[-1] < len(counts):
        done = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, done + _PAIRS, "right"))))
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def nearest(points: DataFrame, boxes: DataFrame, tolerance: float, inclusive: bool = False, last_wins: bool = False) -> DataFrame:
    """For each point (frame_idx, camera_id, point_id, px, py), the box whose centre is nearest within the tolerance.

    Ties go to the first box by det_idx, or to the last.  Points and boxes of a
    frame and camera are a group, bounded by its image; a point is held against the
    boxes around it, not against all of them.
    """
    keys = ["frame_idx", "camera_id"]
    types = {**{f.name: f.dataType for f in boxes.schema}, **{f.name: f.dataType for f in points.schema}}
    names = [*keys, "point_id", "det_idx", "dist"]
    schema = StructType([StructField(n, types.get(n, DoubleType())) for n in names])
    arrow = to_arrow_schema(schema)

    def match(p: pa.Table, b: pa.Table) -> pa.Table:
        if not p.num_rows or not b.num_rows:
            return arrow.empty_table()
        place, box = ([t.column(c).to_numpy() for c in cs] for t, cs in ((p, ("px", "py")), (b, "xywh")))
        tie = b.column("det_idx").to_numpy() * (-1 if last_wins else 1)
        at, dist = _nearest(*place, np.array(box), tie, tolerance, inclusive)
        rows = np.flatnonzero(at >= 0)
        ids = p.column("point_id").combine_chunks()
        code = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False) if ids.null_count == 0 else ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        rows = rows[np.lexsort((tie[at[rows]], dist[rows], code[rows]))]
        rows = rows[np.r_[True, code[rows[1:]] != code[rows[:-1]]]] if len(rows) else rows  # a point that comes twice has one match
        own = p.take(rows)
        return pa.table([*[own.column(c) for c in names[:3]], b.column("det_idx").take(at[rows]), pa.array(dist[rows])], names=names).cast(arrow)

    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    finite = lambda cs: " AND ".join(f"abs({c}) < double('Infinity')" for c in cs)
    number = [F.col(c).cast("double").alias(c) for c in "xywh"]
    b = boxes.select(*[F.col(k).cast(types[k]).alias(k) if boxes.schema[k].dataType != types[k] else k for k in keys], "det_idx", *number).where(f"{known} AND det_idx IS NOT NULL AND {finite('xywh')}")
    p = points.select(*keys, "point_id", F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py")).where(f"{known} AND {finite(('px', 'py'))}")
    return p.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(match, schema)


def _in_windows(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, mx: np.ndarray, my: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (window, point) of the points that lie in a window, borders included, a bounded number at once, those of a window together.

    Points are in bands by their height, and in each in the order of x, so that
    those of a window in a band follow one another but for their height.
    """
    rows = np.argsort(my, kind="stable")
    size = max(64, len(rows) // 64)
    for low in range(0, len(rows), size):
        band = rows[low : low + size]
        wanted = np.flatnonzero((y0 <= my[band[-1]]) & (y1 >= my[band[0]]))
        band = band[np.argsort(mx[band], kind="stable")]
        first, last = np.searchsorted(mx[band], x0[wanted]), np.searchsorted(mx[band], x1[wanted], "right")
        for part in _portions(np.maximum(last - first, 0)):
            n = np.maximum(last[part] - first[part], 0)
            at = band[np.arange(n.sum()) + np.repeat(first[part] - np.cumsum(n) + n, n)]
            window = np.repeat(wanted[part], n)
            inside = (my[at] >= y0[window]) & (my[at] <= y1[window])
            yield window[inside], at[inside]


def in_crops(boxes: DataFrame, margin: float, keep: list[str]) -> DataFrame:
    """(frame_idx, camera_id, crop, inside, ``keep``): for each box, widened by ``margin``, the boxes of its image whose centres are in it.

    ``keep`` are columns of the image.  The boxes of an image are a group; its pairs
    stream out of it, as lists, and are never held or shuffled.
    """
    keys = ["frame_idx", "camera_id"]
    fields = [boxes.schema[k] for k in keys]
    det = boxes.schema["det_idx"].dataType
    schema = StructType([*fields, StructField("crop", det), StructField("all", ArrayType(det)), *[boxes.schema[k] for k in keep]])
    arrow = to_arrow_schema(schema)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image = pa.Table.from_batches(batches)
        x, y, w, h = (image.column(c).to_numpy() for c in "xywh")
        ids = image.column("det_idx").combine_chunks()
        found = _in_windows(x - margin, x + w + margin, y - margin, y + h + margin, x + w / 2, y + h / 2)
        for crop, inside in found:
            if len(crop):
                starts = np.flatnonzero(np.r_[True, crop[1:] != crop[:-1]])
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(crop)), pa.int32()), ids.take(pa.array(inside)))
                same = {c: pa.repeat(image.column(c)[0], len(starts)) for c in (*keys, *keep)}
                columns = [*[same[c] for c in keys], ids.take(pa.array(crop[starts])), lists, *[same[c] for c in keep]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    there = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xywh")
    own = boxes.where(f"frame_idx IS NOT NULL AND camera_id IS NOT NULL AND {there}").select(*keys, "det_idx", *[F.col(c).cast("double").alias(c) for c in "xywh"], *keep)
    return own.groupBy(*keys).applyInArrow(pairs, schema).select(*keys, "crop", F.explode("all").alias("inside"), *keep)


def referenced(boxes: DataFrame, matches: DataFrame) -> DataFrame:
    """Boxes that some match refers to."""
    return boxes.join(matches.select("frame_idx", "camera_id", "det_idx").distinct(), ["frame_idx", "camera_id", "det_idx"], "left_semi")


def adjacency(obs: DataFrame, least_shared: int) -> DataFrame:
    """Camera pairs that share at least so many frames."""
    seen = obs.select("camera_id", "frame_idx").distinct()
    a, b = seen.alias("a"), seen.alias("b")
    pairs = a.join(b, F.expr("a.frame_idx = b.frame_idx AND a.camera_id < b.camera_id"))
    return pairs.groupBy(F.col("a.camera_id").alias("camera_a"), F.col("b.camera_id").alias("camera_b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least_shared)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all points (u, v) of a to all of b."""
    return np.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2)


def _add(sums: np.ndarray, at: np.ndarray, what: np.ndarray | int, repeats: bool) -> None:
    """Adds to places, of which none comes twice unless ``repeats``."""
    if repeats:
        np.add.at(sums, at, what)
    else:
        sums[at] += what


def _affinities(a: blocks.Strip, b: blocks.Strip, tau: float, t_min: int, saturate: int, early_k: int, distance: Distance) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Places (track of a, track of b) that share frames, how many, and their affinity."""
    width, repeats = len(b.ids), a.repeats or b.repeats
    shared, total, early = np.zeros(len(a.ids) * width, np.int32), np.zeros(len(a.ids) * width), np.zeros(len(a.ids) * width, bool)
    for x, y in blocks.meetings(a, b):
        at = (a.code[x] * width)[:, None] + b.code[y]
        _add(shared, at, 1, repeats)
        near = 1 - distance(a.cells[:, x, None], b.cells[:, None, y]) / tau
        hit = near > 0
        spot = at[hit]
        _add(total, spot, near[hit], repeats)
        early[spot[shared[spot] <= early_k]] = True
    met = np.flatnonzero(shared)
    n = shared[met]
    score = total[met] / n * np.minimum(n, saturate) / saturate
    score[(n < t_min) | ((n >= early_k) & ~early[met])] = 0.0
    return met, n, score


def pair_scores(
    obs: DataFrame, cameras: DataFrame, tau: float, t_min: int, saturate: int, early_k: int, distance: Distance = apart, columns: tuple[str, ...] = ("u", "v"), least_score: float | None = None
) -> DataFrame:
    """Affinity of tracklets of adjacent cameras over the frames they share.

    The sum of 1 - d / tau over near frames, by the shared frames, discounted
    until ``saturate`` are shared; none of the first ``early_k`` near, or fewer
    than ``t_min`` shared, is 0.  ``distance`` takes the ``columns`` of two sides.
    Pairs below ``least_score``, and with it those of 0, are left out.  No row is
    made for a shared frame (``blocks``).
    """

    def scored(camera_a: str, camera_b: str, own: list[blocks.Strip], others: list[blocks.Strip], same: bool) -> Iterator[list]:
        for a in own:
            for b in others:
                met, n, score = _affinities(a, b, tau, t_min, saturate, early_k, distance)
                kept = slice(None) if least_score is None else (score >= least_score) & (score > 0)
                met, n, score = met[kept], n[kept], score[kept]
                yield [camera_a, a.ids[met // len(b.ids)], camera_b, b.ids[met % len(b.ids)], n, score]

    rows = blocks.by_pairs(obs, cameras, list(columns), scored, "camera_a string, track_a long, camera_b string, track_b long, n_shared long, score double")
    return rows.withColumns({c: F.nullif(c, F.lit(blocks.NONE)) for c in ("track_a", "track_b")})


def affine_links(obs: DataFrame, cameras: DataFrame, tau: float, t_min: int, saturate: int, early_k: int, least_score: float) -> DataFrame:
    """Links (src, dst) with the same components as the pairs of ``pair_scores`` from ``least_score`` on.

    A task keeps of its pairs only which tracks they connect, so it gives at most a
    link a track.
    """

    def linked(camera_a: str, camera_b: str, own: list[blocks.Strip], others: list[blocks.Strip], same: bool) -> Iterator[list]:
        ids = np.concatenate([s.ids for s in (*own, *others)])
        places = np.cumsum([0, *[len(s.ids) for s in (*own, *others)]])
        label = np.arange(len(ids))
        for i, a in enumerate(own):
            for j, b in enumerate(others):
                met, _, score = _affinities(a, b, tau, t_min, saturate, early_k, apart)
                met = met[(score >= least_score) & (score > 0)]
                src, dst = label[places[i] + met // len(b.ids)], label[places[len(own) + j] + met % len(b.ids)]
                while (src != dst).any():  # the larger of two labels takes the smaller one, until all agree
                    np.minimum.at(label, np.maximum(src, dst), np.minimum(src, dst))
                    while (label[label] != label).any():
                        label = label[label]
                    src, dst = label[src], label[dst]
                    src, dst = src[src != dst], dst[src != dst]
        moved = np.flatnonzero(label != np.arange(len(ids)))
        yield [ids[moved], ids[label[moved]]]

    rows = blocks.by_pairs(obs, cameras, ["u", "v"], linked, "src long, dst long")
    return rows.select(*[F.nullif(c, F.lit(blocks.NONE)).alias(c) for c in ("src", "dst")]).distinct()


def swept(obs: DataFrame, cameras: DataFrame, grid: list[tuple[float, float, int]], saturate: int) -> DataFrame:
    """(tau, least, t_min, n_pairs, total) of each task: of the pairs of tracks that ``grid`` accepts, how many and the sum of their mean distances.

    A pair is accepted by (tau, least, t_min) if it shares ``t_min`` frames and its
    affinity without an early exit is ``least`` or more.
    """
    taus = sorted({t for t, _, _ in grid}, reverse=True)

    def counted(camera_a: str, camera_b: str, own: list[blocks.Strip], others: list[blocks.Strip], same: bool) -> Iterator[list]:
        n_pairs, totals = np.zeros(len(grid), np.int64), np.zeros(len(grid))
        for a in own:
            for b in others:
                width, repeats = len(b.ids), a.repeats or b.repeats
                shared, lost, far = np.zeros(len(a.ids) * width, np.int32), np.zeros(len(a.ids) * width, np.int32), np.zeros(len(a.ids) * width)
                near = [np.zeros(len(a.ids) * width) for _ in taus]
                for x, y in blocks.meetings(a, b):
                    at = (a.code[x] * width)[:, None] + b.code[y]
                    d = apart(a.cells[:, x, None], b.cells[:, None, y])
                    _add(shared, at, 1, repeats)
                    none = np.isnan(d)
                    if none.any():
                        _add(lost, at, none, repeats)
                    _add(far, at, np.where(none, 0.0, d), repeats)
                    for tau, sums in zip(taus, near, strict=True):  # from the largest on
                        hit = d < tau
                        at, d = at[hit], d[hit]
                        _add(sums, at, 1 - d / tau, repeats)
                met = np.flatnonzero(shared)
                n, mean = shared[met], far[met] / np.maximum(shared[met] - lost[met], 1)
                for k, (tau, least, t_min) in enumerate(grid):
                    kept = (n >= t_min) & (near[taus.index(tau)][met] / n * np.minimum(n, saturate) / saturate >= least)
                    n_pairs[k] += kept.sum()
                    totals[k] += mean[kept].sum()
        found = np.flatnonzero(n_pairs)
        yield [np.array([float(grid[k][0]) for k in found]), np.array([float(grid[k][1]) for k in found]), np.array([grid[k][2] for k in found], np.int64), n_pairs[found], totals[found]]

    return blocks.by_pairs(obs, cameras, ["u", "v"], counted, "tau double, least double, t_min long, n_pairs long, total double")


def must_not_link(obs: DataFrame) -> DataFrame:
    """Tracklets of one camera that are both detected in a frame can't be one animal."""

    def together(camera: str, _: str, own: list[blocks.Strip], others: list[blocks.Strip], same: bool) -> Iterator[list]:
        for i, a in enumerate(own):
            for b in others[i:] if same else others:
                frames = np.intersect1d(a.frames, b.frames, assume_unique=True)
                met = np.zeros((len(a.ids), len(b.ids)), bool)
                for k in range(0, len(frames), _FRAMES):
                    x, y = (_presence(s, frames[k : k + _FRAMES]) for s in (a, b))
                    met |= x @ y.T > 0
                if same and a.ids[0] == b.ids[0]:
                    met = np.triu(met, 1)
                row, column = np.nonzero(met)
                yield [camera, np.minimum(a.ids[row], b.ids[column]), np.maximum(a.ids[row], b.ids[column])]

    seen = obs.where("status = 'detected' AND track_id IS NOT NULL")
    return blocks.by_pairs(seen, None, [], together, "camera_id string, track_a long, track_b long")


def must_not_share(obs: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst) of nodes of one community that one camera detects in a frame; ``obs`` has (camera_id, node, frame_idx, status), ``members`` (node, community)."""
    own = obs.select("camera_id", "node", "frame_idx", "status").join(members.select("node", "community"), "node").where("camera_id IS NOT NULL")
    place = F.concat_ws("/", F.col("community").cast("string"), "camera_id").alias("camera_id")
    return must_not_link(own.select(place, F.col("node").alias("track_id"), "frame_idx", "status")).select(F.col("track_a").alias("src"), F.col("track_b").alias("dst"))


def _presence(strip: blocks.Strip, frames: np.ndarray) -> np.ndarray:
    """1 where a track has a frame."""
    at = np.repeat(strip.frames, np.diff(strip.starts))
    column = np.minimum(np.searchsorted(frames, at), len(frames) - 1)
    there = frames[column] == at
    out = np.zeros((len(strip.ids), len(frames)), np.float32)
    out[strip.code[there], column[there]] = 1
    return out


def gaps(visible: DataFrame, contributing: DataFrame, least: int) -> DataFrame:
    """(id, camera_id) of cameras that could see it and don't contribute, where at least so many do."""
    enough = contributing.groupBy("id").agg(F.count_distinct("camera_id").alias("n")).where(F.col("n") >= least)
    return visible.join(enough, "id", "left_semi").join(contributing, ["id", "camera_id"], "left_anti").select("id", "camera_id")


def voxel_key(coordinate: Column, low: float, size: float) -> Column:
    """The index of the voxel nearest to a coordinate; halves go to the even one."""
    return F.bround((coordinate - low) / size).cast("bigint")


def overlap_graph(voxels: DataFrame, least: int) -> DataFrame:
    """Camera pairs that see at least so many voxels (voxel, camera_id) together."""
    a, b = voxels.alias("a"), voxels.alias("b")
    pairs = a.join(b, F.expr("a.voxel = b.voxel AND a.camera_id < b.camera_id"))
    return pairs.groupBy(F.col("a.camera_id").alias("camera_a"), F.col("b.camera_id").alias("camera_b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
