"""Interpolation on unit lattices by not-a-knot splines and by monotone cubic pieces, and what stands in for missing values."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def knots(n: int, order: int) -> np.ndarray:
    """Knots of the interpolating spline of odd order through 0, 1, ..., n - 1: the inner nodes, without those next to the ends."""
    half = (order - 1) // 2
    return np.r_[[0.0] * (order + 1), np.arange(half + 1, n - half - 1, dtype="float64"), [n - 1.0] * (order + 1)]


def basis(x: np.ndarray, n: int, order: int) -> np.ndarray:
    """Values of the ``n`` basis splines at places from 0 to n - 1, a row each (Cox-de Boor)."""
    t = knots(n, order)
    x = np.asarray(x, dtype="float64")[:, None]
    low, high = t[None, :-1], t[None, 1:]
    out = ((x >= low) & (x < high)).astype("float64")
    last = int(np.flatnonzero(t[:-1] < t[1:])[-1])
    out[(x[:, 0] >= t[-1]), last] = 1.0
    for k in range(1, order + 1):
        left, right = t[k:-1] - t[: -k - 1], t[k + 1 :] - t[1:-k]
        a = np.where(left > 0, (x - t[None, : -k - 1]) / np.where(left > 0, left, 1.0), 0.0)
        b = np.where(right > 0, (t[None, k + 1 :] - x) / np.where(right > 0, right, 1.0), 0.0)
        out = a * out[:, :-1] + b * out[:, 1:]
    return out


@lru_cache(maxsize=64)
def _inverse(n: int, order: int) -> np.ndarray:
    return np.linalg.inv(basis(np.arange(n), n, order))


def spline(values: np.ndarray, i: np.ndarray, j: np.ndarray, order: int) -> np.ndarray:
    """A tensor spline through all values (none missing), at rows ``i`` and columns ``j``; too few nodes lower the order."""
    orders = [min(order, (n - 1) - (n - 1) % 2 - 1 if n > 1 else 0) if n <= order else order for n in values.shape]
    sides = []
    for x, n, k in zip((i, j), values.shape, orders, strict=True):
        sides.append(np.ones((len(x), 1)) if n == 1 else basis(x, n, max(1, k)) @ _inverse(n, max(1, k)))
    return np.einsum("pi,ij,pj->p", sides[0], values, sides[1], optimize=True)


def _monotone(y: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Monotone cubic through the four nodes (p, 4) around places ``x`` of a line of ``n`` nodes; nodes beyond its ends count for nothing."""
    if n == 1:
        return y[:, 1]
    at = np.clip(np.floor(x), 0, n - 2)
    t = x - at
    slope = np.diff(y, axis=1)  # before, within and after the piece
    first, last = at == 0, at == n - 2

    def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a * b > 0, 2 / (1 / a + 1 / b), 0.0)

    def end(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (3 * a - b) / 2
        d = np.where(np.sign(d) != np.sign(a), 0.0, np.where((np.sign(a) != np.sign(b)) & (np.abs(d) > 3 * np.abs(a)), 3 * a, d))
        return a if n == 2 else d

    d0 = np.where(first, end(slope[:, 1], slope[:, 2]), inner(slope[:, 0], slope[:, 1]))
    d1 = np.where(last, end(slope[:, 1], slope[:, 0]), inner(slope[:, 1], slope[:, 2]))
    return y[:, 1] * (1 + 2 * t) * (1 - t) ** 2 + d0 * t * (1 - t) ** 2 + y[:, 2] * t * t * (3 - 2 * t) + d1 * t * t * (t - 1)


def monotone(values: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Monotone cubics along the rows around each place, then one across them."""
    h, w = values.shape
    around = lambda x, n: np.clip(np.clip(np.floor(x), 0, max(0, n - 2)).astype("int64")[:, None] + np.arange(-1, 3), 0, n - 1)
    rows, cols = around(i, h), around(j, w)
    lines = np.stack([_monotone(values[rows[:, k, None], cols], j, w) for k in range(4)], axis=1)
    return _monotone(lines, i, h)


def filled(values: np.ndarray) -> np.ndarray:
    """Missing values (NaN) as the nearest known one; 0 if none is."""
    known = ~np.isnan(values)
    if known.all():
        return values
    if not known.any():
        return np.zeros_like(values)
    h, w = values.shape
    up = np.maximum.accumulate(np.where(known, np.arange(h)[:, None], -(h + w) * 4), axis=0)
    down = np.minimum.accumulate(np.where(known, np.arange(h)[:, None], (h + w) * 5)[::-1], axis=0)[::-1]
    rows = np.arange(h)[:, None]
    nearest = np.where(rows - up <= down - rows, up, down)  # in the same column
    out = values.copy()
    gap = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
    for r in np.flatnonzero(~known.all(axis=1)):
        lack = np.flatnonzero(~known[r])
        best = (gap[lack] + (nearest[r] - r)[None, :] ** 2).argmin(axis=1)
        out[r, lack] = values[np.clip(nearest[r, best], 0, h - 1), best]
    return out


def spread(lacking: np.ndarray, steps: int) -> np.ndarray:
    """Cells within so many steps along rows and columns of a lacking one."""
    out = lacking.copy()
    for _ in range(steps):
        wide = out.copy()
        wide[1:] |= out[:-1]
        wide[:-1] |= out[1:]
        wide[:, 1:] |= out[:, :-1]
        wide[:, :-1] |= out[:, 1:]
        out = wide
    return out
