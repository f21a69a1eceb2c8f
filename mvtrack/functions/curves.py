"""Curves as arrays: spline bases, arc lengths and interpolation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL, DEGREE = 7, 3


def knots(control: int = CONTROL, degree: int = DEGREE) -> list[float]:
    """A clamped knot vector over 0 to 1 with evenly spread inner knots."""
    inner = control - degree
    return [0.0] * degree + [k / inner for k in range(inner + 1)] + [1.0] * degree


def basis(t: float, control: int = CONTROL, degree: int = DEGREE) -> list[float]:
    """The weights of the control points at t, by the recursion over degrees."""
    at = knots(control, degree)
    last = max(k for k in range(len(at) - 1) if at[k] < at[k + 1])
    now = [1.0 if at[k] <= t < at[k + 1] or (t == 1.0 and k == last) else 0.0 for k in range(len(at) - 1)]
    for d in range(1, degree + 1):
        left = [(t - at[k]) / (at[k + d] - at[k]) if at[k + d] > at[k] else 0.0 for k in range(len(at) - d)]
        now = [left[k] * now[k] + (1 - left[k + 1] if at[k + d + 1] > at[k + 1] else 0.0) * now[k + 1] for k in range(len(now) - 1)]
    return now


def evaluated(control_points: Column, names: list[str], ts: list[float]) -> Column:
    """The curve at fixed parameters: an array of structs; the basis is constant, so each is a weighted sum."""

    def at(t: float, name: str) -> Column:
        terms = [w * control_points[k][name] for k, w in enumerate(basis(t)) if w]
        return sum(terms[1:], terms[0])

    return F.array(*[F.struct(*[at(t, n).alias(n) for n in names]) for t in ts])


def interpolated(q: str, ts: str, values: str, extrapolate: bool = False) -> str:
    """SQL: the value at q by straight lines between (ts, values), which are in order, two at least; beyond the ends the last line or the last value."""
    at = f"least(greatest(size(filter({ts}, a -> a <= {q})), 1), size({ts}) - 1)"
    x = q if extrapolate else f"least(greatest({q}, {ts}[0]), element_at({ts}, -1))"
    line = "v[i - 1] + ({x} - t[i - 1]) / (t[i] - t[i - 1]) * (v[i] - v[i - 1])"
    return f"transform(array({at}), i -> {line.format(x=x).replace('v[', values + '[').replace('t[', ts + '[')})[0]"


def arc_lengths(points: str) -> str:
    """SQL: lengths along an array of (x, y) from its start to each point, as shares of the whole; zeros where there is no length."""
    steps = f"transform(sequence(1, size({points}) - 1), i -> sqrt(power({points}[i].x - {points}[i - 1].x, 2) + power({points}[i].y - {points}[i - 1].y, 2)))"
    sums = f"aggregate({steps}, array(0D), (s, d) -> concat(s, array(element_at(s, -1) + d)))"
    return f"transform(array({sums}), s -> transform(s, x -> IF(element_at(s, -1) > 1e-12, x / element_at(s, -1), 0D)))[0]"
