"""Geometry of rays, points and boxes as Column expressions: no row leaves generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def along(o: Vec, d: Vec, t: Column) -> Vec:
    return tuple(x + t * y for x, y in zip(o, d, strict=True))


def scaled(a: Vec, s: Column) -> Vec:
    return tuple(x * s for x in a)


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def closest_approach(oa: Vec, da: Vec, ob: Vec, db: Vec) -> tuple[Column, Vec]:
    """Distance and midpoint of the closest approach of two lines; directions of any length.

    Parallel lines are met at the first one's origin.
    """
    w = sub(oa, ob)
    a, b, c, d, e = dot(da, da), dot(da, db), dot(db, db), dot(da, w), dot(db, w)
    denom = a * c - b * b
    parallel = F.abs(denom) < 1e-12
    t = F.when(parallel, 0.0).otherwise((b * e - c * d) / F.when(parallel, 1.0).otherwise(denom))
    s = F.when(parallel, e / c).otherwise((a * e - b * d) / F.when(parallel, 1.0).otherwise(denom))
    p, q = along(oa, da, t), along(ob, db, s)
    return norm(sub(p, q)), tuple((x + y) / 2 for x, y in zip(p, q, strict=True))


def point_line_distance(p: Vec, o: Vec, d: Vec) -> Column:
    """Perpendicular distance of a point from a line; the direction may have any length."""
    w = sub(p, o)
    t = dot(w, d) / dot(d, d)
    return norm(sub(w, scaled(d, t)))


def refract(pixel: tuple[Column, Column], fx: float, cx: float, cy: float, centre: Vec, water_z: float, n_air: float = 1.0, n_water: float = 1.333, fy: float | None = None) -> tuple[Vec, Vec]:
    """Ray under a horizontal water plane of a pixel of a camera that looks straight down: origin and unit direction.

    Total reflection cannot occur on the way into the denser medium; its clamp keeps the root real elsewhere.
    """
    x, y = (pixel[0] - cx) / fx, (pixel[1] - cy) / (fx if fy is None else fy)
    length = F.sqrt(x * x + y * y + 1)
    d = (x / length, y / length, 1 / length)
    t = (F.lit(water_z) - centre[2]) / d[2]
    origin = along(centre, d, t)
    ratio = n_air / n_water
    down = F.sqrt(F.greatest(F.lit(0.0), 1 - ratio * ratio * (1 - d[2] * d[2])))
    bent = (ratio * d[0], ratio * d[1], down)
    return origin, scaled(bent, 1 / norm(bent))


def project(p: Vec, fx: float, cx: float, cy: float, centre: Vec, water_z: float, n_air: float = 1.0, n_water: float = 1.333, fy: float | None = None) -> tuple[Column, Column]:
    """Pixel of a point under water, for a camera that looks straight down; null at or above the surface.

    The radius at which the ray crosses the surface is found by ten Newton steps
    between 0 and the point's own radius.
    """
    dx, dy = p[0] - centre[0], p[1] - centre[1]
    r, air = F.sqrt(dx * dx + dy * dy), F.lit(water_z) - centre[2]
    depth = F.when(p[2] > water_z, p[2] - water_z)

    def step(now: Column, _: Column) -> Column:
        x, far, air2, depth2 = now["x"], now["r"] - now["x"], now["air2"], now["depth2"]
        a, b = x * x + air2, far * far + depth2
        f = n_air * x / F.sqrt(a) - n_water * far / F.sqrt(b)
        slope = n_air * air2 / F.pow(a, F.lit(1.5)) + n_water * depth2 / F.pow(b, F.lit(1.5))
        return F.struct(F.greatest(F.lit(0.0), F.least(now["r"], x - f / slope)).alias("x"), now["r"].alias("r"), air2.alias("air2"), depth2.alias("depth2"))

    # What the steps need goes along as values, and both coordinates share the one result.
    first = F.struct((r * air / (air + depth)).alias("x"), r.alias("r"), (air * air).alias("air2"), (depth * depth).alias("depth2"))
    x = F.aggregate(F.sequence(F.lit(1), F.lit(10)), first, step)["x"]
    scale = F.when(p[2] > water_z, x / F.greatest(r, F.lit(1e-300)) / air)
    return cx + fx * dx * scale, cy + (fx if fy is None else fy) * dy * scale


def half_width_metres(pixels: Column, depth: Column, focal: Column) -> Column:
    return pixels * depth / focal


def affine(x: Column, y: Column, m: tuple[float, ...]) -> tuple[Column, Column]:
    """A 2 by 3 map given row by row."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def inverse_affine(x: Column, y: Column, m: tuple[float, ...]) -> tuple[Column, Column]:
    det = m[0] * m[4] - m[1] * m[3]
    u, v = x - m[2], y - m[5]
    return (m[4] * u - m[1] * v) / det, (m[0] * v - m[3] * u) / det


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def solve3(m: list[list[Column]], b: list[Column]) -> tuple[Column, Vec]:
    """Determinant and solution of a 3 by 3 system, by cofactors; null where singular."""

    def det(p: list[list[Column]]) -> Column:
        return p[0][0] * (p[1][1] * p[2][2] - p[1][2] * p[2][1]) - p[0][1] * (p[1][0] * p[2][2] - p[1][2] * p[2][0]) + p[0][2] * (p[1][0] * p[2][1] - p[1][1] * p[2][0])

    whole = det(m)
    safe = F.when(F.abs(whole) > 1e-12, whole)
    return whole, tuple(det([[b[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]) / safe for k in range(3))


def triangulation_terms(o: Vec, d: Vec, weight: Column) -> dict[str, Column]:
    """Nine terms of a weighted ray; their sums over rays give the least-squares point."""
    unit = scaled(d, 1 / norm(d))
    entry = {(i, j): weight * ((1.0 if i == j else 0.0) - unit[i] * unit[j]) for i in range(3) for j in range(i, 3)}
    sym = lambda i, j: entry[min(i, j), max(i, j)]
    right = [sum((sym(i, j) * o[j] for j in range(1, 3)), sym(i, 0) * o[0]) for i in range(3)]
    return {f"m{i}{j}": e for (i, j), e in entry.items()} | {f"b{i}": r for i, r in enumerate(right)}


def triangulation_sums(o: Vec, d: Vec, weight: Column) -> list[Column]:
    """The sums of the terms, which combine before the shuffle."""
    return [F.sum(c).alias(n) for n, c in triangulation_terms(o, d, weight).items()]


def triangulated() -> Vec:
    """The point, from the sums."""
    sym = lambda i, j: F.col(f"m{min(i, j)}{max(i, j)}")
    return solve3([[sym(i, j) for j in range(3)] for i in range(3)], [F.col(f"b{i}") for i in range(3)])[1]


def curvature(points: str, axes: str = "xy") -> Column:
    """Mean over an array's inner points of the difference of their two steps by the steps' mean length; steps without a length count as one."""
    size_of = lambda parts: "sqrt(" + " + ".join(f"power({p}, 2)" for p in parts) + ")"
    step = lambda i, j: size_of([f"{points}[{i}].{a} - {points}[{j}].{a}" for a in axes])
    turn = size_of([f"{points}[i + 1].{a} - 2 * {points}[i].{a} + {points}[i - 1].{a}" for a in axes])
    mean = f"0.5D * ({step('i + 1', 'i')} + {step('i', 'i - 1')})"
    each = f"transform(sequence(1, size({points}) - 2), i -> {turn} / IF({mean} > 1e-12, {mean}, 1D))"
    return F.expr(f"IF(size({points}) < 3, NULL, aggregate({each}, 0D, (s, v) -> s + v) / (size({points}) - 2))")


def principal_angle(sxx: Column, sxy: Column, syy: Column) -> Column:
    """Angle of the main axis of a 2 by 2 covariance."""
    return 0.5 * F.atan2(2 * sxy, sxx - syy)


def confidence_score(residual: Column, cameras: Column, variance: Column) -> Column:
    """How far a reconstruction is to be trusted: residual, number of cameras and spread of residuals, in 0 to 1."""
    return 0.5 * F.greatest(F.lit(0.0), 1 - residual / 10) + 0.3 * clip((cameras - 2) / 6, 0.0, 1.0) + 0.2 * F.greatest(F.lit(0.0), 1 - variance / 25)


def camera_position(rotation: list[list[Column]], t: Vec) -> Vec:
    """Minus the transposed rotation times the translation."""
    return tuple(-(rotation[0][k] * t[0] + rotation[1][k] * t[1] + rotation[2][k] * t[2]) for k in range(3))


# -- boxes and keypoints as arrays of (x, y) -------------------------------------------------------


def principal_box(points: str, pad: float, end: float = 2.0) -> str:
    """SQL: corners of the box along the main axis of the points, ``end`` longer at both ends and ``pad`` wide to each side.

    The box is as long to either side of the centroid as the farther point.
    Fewer than two points have a square of 20 around the one, or the origin.
    """
    n = f"size({points})"
    mean = {a: f"aggregate({points}, 0D, (s, p) -> s + p.{a}) / {n}" for a in "xy"}
    moment = lambda a, b: f"aggregate({points}, 0D, (s, p) -> s + (p.{a} - c.{a}) * (p.{b} - c.{b}))"
    angle = f"0.5D * atan2(2 * {moment('x', 'y')}, {moment('x', 'x')} - {moment('y', 'y')})"
    reach = f"array_max(transform({points}, p -> abs((p.x - c.x) * cos(c.t) + (p.y - c.y) * sin(c.t)))) + {end}D"
    centre = f"transform(array(struct({mean['x']} AS x, {mean['y']} AS y)), c -> struct(c.x AS x, c.y AS y, {angle} AS t))"
    sides = f"transform({centre}, c -> struct(c.x AS x, c.y AS y, c.t AS t, {reach} AS m))[0]"
    corner = f"struct(b.x + k.a * b.m * cos(b.t) - k.b * {pad}D * sin(b.t) AS x, b.y + k.a * b.m * sin(b.t) + k.b * {pad}D * cos(b.t) AS y)"
    ways = "array(struct(-1 AS a, -1 AS b), struct(1 AS a, -1 AS b), struct(1 AS a, 1 AS b), struct(-1 AS a, 1 AS b))"
    square = f"transform({ways}, k -> struct(coalesce({points}[0].x, 0D) + k.a * 10D AS x, coalesce({points}[0].y, 0D) + k.b * 10D AS y))"
    return f"IF({n} < 2, {square}, flatten(transform(array({sides}), b -> transform({ways}, k -> {corner}))))"


def clipped(points: str, width: int, height: int) -> str:
    """SQL: the points moved into the image."""
    return f"transform({points}, p -> struct(greatest(0D, least({width - 1}D, p.x)) AS x, greatest(0D, least({height - 1}D, p.y)) AS y))"


def snapped(x: str, y: str, width: int, height: int, within: float) -> str:
    """SQL: (x, y), on the nearest border where that is nearer than ``within``; of equal ones left, right, top, bottom."""
    far = f"array({x}, {width - 1}D - {x}, {y}, {height - 1}D - {y})"
    side = f"array_position({far}, array_min({far}))"
    new = f"struct(CASE {side} WHEN 1 THEN 0D WHEN 2 THEN {width - 1}D ELSE {x} END AS x, CASE {side} WHEN 3 THEN 0D WHEN 4 THEN {height - 1}D ELSE {y} END AS y)"
    return f"IF(least({x}, {y}, {width}D - {x}, {height}D - {y}) < {within}D, {new}, struct({x} AS x, {y} AS y))"


def bent(points: str, shares: str, profile: str) -> str:
    """SQL: the points moved along the normal of their chord by ``profile`` of the chord's length, where t is their share of the way; the centroid stays.

    A curve without a chord or a length stays as it is.
    """
    chord = f"struct(element_at({points}, -1).x - {points}[0].x AS x, element_at({points}, -1).y - {points}[0].y AS y)"
    moved = f"transform({points}, (p, i) -> transform(array({shares}[i]), t -> {profile})[0])"
    mean = "aggregate(d, 0D, (s, v) -> s + v) / size(d)"
    out = f"transform({points}, (p, i) -> struct(p.x - c.y * (d[i] - {mean}) AS x, p.y + c.x * (d[i] - {mean}) AS y))"
    made = f"flatten(transform(array({chord}), c -> flatten(transform(array({moved}), d -> {out}))))"
    return f"IF(sqrt(power(({chord}).x, 2) + power(({chord}).y, 2)) < 1e-12 OR element_at({shares}, -1) = 0, {points}, {made})"
