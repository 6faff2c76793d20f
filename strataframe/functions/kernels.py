"""Heavier geometry in numpy, batch by batch through Arrow. A shape is a list of polygons (or lines) of rings of (x, y)."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strataframe.functions import overlay
from strataframe.functions.geometry import GEOMETRY
from strataframe.functions.shapes import Shape, points_inside

_VERTEX = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW_GEOMETRY = pa.struct([("type", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(_VERTEX))))])


class Value:
    """A geometry in a Python rule: its type, and its shape as arrays."""

    __slots__ = ("kind", "shape")

    def __init__(self, kind: str | None, shape: Shape):
        self.kind, self.shape = kind, shape

    def __getitem__(self, name: str):
        return self.kind if name == "type" else [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in self.shape]


def shape_of(value: Value | dict | None) -> Shape:
    """Arrays of a geometry value; null and empty give an empty shape."""
    if isinstance(value, Value):
        return value.shape
    if not value or not value["parts"]:
        return []
    return [[np.array([(v["x"], v["y"]) for v in ring], dtype="float64").reshape(-1, 2) for ring in part or [] if ring] for part in value["parts"] if part]


def value_of(kind: str, shape: Shape) -> Value:
    return Value(kind, [[np.asarray(ring, dtype="float64").reshape(-1, 2) for ring in part] for part in shape])


def all_points(shape: Shape) -> np.ndarray:
    rings = [r for p in shape for r in p]
    return np.concatenate(rings) if rings else np.empty((0, 2))


def decode(column: pa.Array) -> list[Value | None]:
    """Geometries of an Arrow column, cut out of its flat coordinates; empty rings and parts are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kinds, lists = column.field(0).to_pylist(), column.field(1)
    rings = lists.values
    vertices = rings.values
    spots = vertices.values
    per_row, per_part, per_ring = (np.asarray(x.offsets) for x in (lists, rings, vertices))
    xy = np.stack([np.asarray(spots.field(k).to_numpy(zero_copy_only=False), dtype="float64") for k in (0, 1)], axis=1)
    out: list[Value | None] = []
    for k, (kind, known, held) in enumerate(zip(kinds, column.is_valid().to_pylist(), lists.is_valid().to_pylist(), strict=True)):
        if not known:
            out.append(None)
            continue
        shape = [[xy[per_ring[r] : per_ring[r + 1]] for r in range(per_part[p], per_part[p + 1]) if per_ring[r + 1] > per_ring[r]] for p in range(per_row[k], per_row[k + 1])] if held else []
        out.append(Value(kind, [p for p in shape if p]))
    return out


def encode(values: list) -> pa.Array:
    """The Arrow column of geometries."""
    plain = [v if isinstance(v, Value) or v is None else Value(v["type"], shape_of(v)) for v in values]
    parts = [p for v in plain if v for p in v.shape]
    rings = [r for p in parts for r in p]
    xy = np.concatenate(rings) if rings else np.empty((0, 2))
    ends = lambda sizes: pa.array(np.r_[0, np.cumsum(np.array(list(sizes), dtype="int64"))].astype("int32"))
    spots = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, 0])), pa.array(np.ascontiguousarray(xy[:, 1]))], fields=list(_VERTEX))
    nested = pa.ListArray.from_arrays(ends(len(v.shape) if v else 0 for v in plain), pa.ListArray.from_arrays(ends(map(len, parts)), pa.ListArray.from_arrays(ends(map(len, rings)), spots)))
    kinds = pa.array([v.kind if v else None for v in plain], pa.string())
    made = pa.StructArray.from_arrays([kinds, nested.cast(ARROW_GEOMETRY.field(1).type)], fields=list(ARROW_GEOMETRY), mask=pa.array([v is None for v in plain], pa.bool_()))
    return made


def boxes_meet(a: Value, b: Value) -> bool:
    p, q = all_points(a.shape), all_points(b.shape)
    return bool(len(p) and len(q) and (p.min(axis=0) <= q.max(axis=0)).all() and (q.min(axis=0) <= p.max(axis=0)).all())


def _udf(rule: Callable, kind: str, arrow: pa.DataType, apart: bool | None = None):
    """Column function of a rule on geometry values and plain numbers; a null argument gives null.

    ``apart`` is the answer for two geometries whose boxes don't meet, for which the rule isn't asked.
    """

    @lru_cache(maxsize=1)
    def made():  # types are read by a session, so not before there is one
        def run(*columns: pa.Array) -> pa.Array:
            rows = zip(*[decode(c) if pa.types.is_struct(c.type) else c.to_pylist() for c in columns], strict=True)
            answer = lambda row: None if any(v is None for v in row) else apart if apart is not None and not boxes_meet(*row[:2]) else rule(*row)
            found = [answer(row) for row in rows]
            return encode(found) if arrow == ARROW_GEOMETRY else pa.array(found, arrow)

        return F.arrow_udf(run, kind)

    return lambda *columns: made()(*columns)


def _geometry(rule: Callable):
    return _udf(rule, GEOMETRY, ARROW_GEOMETRY)


def _number(rule: Callable):
    return _udf(rule, "double", pa.float64())


def _flag(rule: Callable, apart: bool | None = None):
    return _udf(rule, "boolean", pa.bool_(), apart)


# --- hulls and circles


def hull(points: np.ndarray) -> np.ndarray:
    """Closed convex hull, counter-clockwise from the least point (monotone chain)."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(order: np.ndarray) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    ring = half(pts)[:-1] + half(pts[::-1])[:-1]
    return np.array([*ring, ring[0]])


def bounding_circle(points: np.ndarray) -> tuple[float, float, float]:
    """Centre and radius of the least circle around points."""
    pts = hull(points)
    pts = pts[:-1] if len(pts) > 3 else pts
    if not len(pts):
        return math.nan, math.nan, math.nan

    def through(p: np.ndarray) -> tuple[float, float, float]:
        if len(p) == 1:
            return p[0][0], p[0][1], 0.0
        if len(p) == 2:
            c = (p[0] + p[1]) / 2
            return c[0], c[1], math.dist(p[0], p[1]) / 2
        (ax, ay), (bx, by), (cx, cy) = p
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if d == 0:
            far = max(((p[i], p[j]) for i in range(3) for j in range(i)), key=lambda q: math.dist(*q))
            return through(np.array(far))
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / d, (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / d
        return ux, uy, math.dist((ux, uy), p[0])

    def outside(c: tuple[float, float, float], p: np.ndarray) -> bool:
        return math.dist(c[:2], p) > c[2] * (1 + 1e-12) + 1e-12

    c = through(pts[:1])
    for i in range(1, len(pts)):
        if outside(c, pts[i]):
            c = through(pts[i : i + 1])
            for j in range(i):
                if outside(c, pts[j]):
                    c = through(pts[[i, j]])
                    for k in range(j):
                        if outside(c, pts[k]):
                            c = through(pts[[i, j, k]])
    return c


def rotated_box(points: np.ndarray) -> np.ndarray:
    """Closed ring of the rectangle of least area around points; one side lies on a side of the hull."""
    ring = hull(points)
    if len(ring) < 4:
        return ring
    best, out = math.inf, ring
    for side in np.diff(ring, axis=0):
        u = side / np.hypot(*side)
        turn = np.array([[u[0], u[1]], [-u[1], u[0]]])
        flat = ring @ turn.T
        (x0, y0), (x1, y1) = flat.min(axis=0), flat.max(axis=0)
        if (x1 - x0) * (y1 - y0) < best:
            best = (x1 - x0) * (y1 - y0)
            out = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]) @ turn
    return out


# --- lines


def simplify_line(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Vertices that are farther than the tolerance from the line without them (Douglas-Peucker)."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = segment_distance(line[a + 1 : b], line[a], line[b])
        k = int(np.argmax(d))
        if d[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def segment_distance(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = b - a
    square = float(step @ step)
    t = np.clip((points - a) @ step / square, 0, 1) if square else np.zeros(len(points))
    return np.hypot(*(points - a - t[:, None] * step).T)


def along(line: np.ndarray, distance: float, normalized: bool = False) -> np.ndarray:
    """Point at a distance along a line; negative distances count from its end."""
    steps = np.hypot(*np.diff(line, axis=0).T)
    total = steps.sum()
    distance = distance * total if normalized else distance
    distance = min(max(distance + total if distance < 0 else distance, 0.0), total)
    at = np.r_[0, np.cumsum(steps)]
    return np.array([np.interp(distance, at, line[:, 0]), np.interp(distance, at, line[:, 1])])


def project_point(line: np.ndarray, x: float, y: float) -> float:
    """Distance along a line to the place nearest to a point."""
    p = np.array([x, y])
    a, step = line[:-1], np.diff(line, axis=0)
    square = np.maximum((step**2).sum(axis=1), 1e-300)
    t = np.clip(((p - a) * step).sum(axis=1) / square, 0, 1)
    near = np.hypot(*(a + t[:, None] * step - p).T)
    k = int(np.argmin(near))
    return float(np.hypot(*step[:k].T).sum() + t[k] * math.sqrt(square[k])) if len(step) else 0.0


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    """Greatest distance from a vertex of one to the nearest vertex of the other."""
    if not len(a) or not len(b):
        return math.nan
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    return float(max(d.min(axis=1).max(), d.min(axis=0).max()))


def frechet(a: np.ndarray, b: np.ndarray) -> float:
    """Discrete Frechet distance."""
    if not len(a) or not len(b):
        return math.nan
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    row = np.maximum.accumulate(d[0])
    for i in range(1, len(a)):
        nxt = np.empty_like(row)
        nxt[0] = max(row[0], d[i, 0])
        for j in range(1, len(b)):
            nxt[j] = max(min(row[j], row[j - 1], nxt[j - 1]), d[i, j])
        row = nxt
    return float(row[-1])


# --- relations


def _segments(shape: Shape, close: bool) -> np.ndarray:
    out = []
    for part in shape:
        for r in part:
            ring = np.vstack([r, r[:1]]) if close and len(r) > 1 and (r[0] != r[-1]).any() else r
            out.append(np.hstack([ring[:-1], ring[1:]]) if len(ring) > 1 else np.hstack([ring, ring]))
    return np.concatenate(out) if out else np.empty((0, 4))


def segments_meet(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Matrix of which segments share a point."""
    ax, ay, bx, by = (s[:, None, k] for k in range(4))
    cx, cy, dx, dy = (t[None, :, k] for k in range(4))

    def side(px, py, qx, qy, rx, ry):
        return np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))

    o1, o2, o3, o4 = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy), side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)

    def on(px, py, qx, qy, rx, ry):
        return (np.minimum(px, qx) <= rx) & (rx <= np.maximum(px, qx)) & (np.minimum(py, qy) <= ry) & (ry <= np.maximum(py, qy))

    proper = (o1 != o2) & (o3 != o4)
    return proper | ((o1 == 0) & on(ax, ay, bx, by, cx, cy)) | ((o2 == 0) & on(ax, ay, bx, by, dx, dy)) | ((o3 == 0) & on(cx, cy, dx, dy, ax, ay)) | ((o4 == 0) & on(cx, cy, dx, dy, bx, by))


def _area(value: Value) -> bool:
    return "polygon" in (value["type"] or "").lower()


def intersects(a: dict, b: dict) -> bool:
    """Whether two geometries share a point."""
    p, q = shape_of(a), shape_of(b)
    va, vb = all_points(p), all_points(q)
    if not len(va) or not len(vb) or (va.min(axis=0) > vb.max(axis=0)).any() or (vb.min(axis=0) > va.max(axis=0)).any():
        return False
    if segments_meet(_segments(p, _area(a)), _segments(q, _area(b))).any():
        return True
    return bool((_area(a) and points_inside(vb[:, 0], vb[:, 1], p).any()) or (_area(b) and points_inside(va[:, 0], va[:, 1], q).any()))


def _crossing(a: dict, b: dict) -> bool:
    """Whether the interiors of segments of both cross."""
    s, t = _segments(shape_of(a), _area(a)), _segments(shape_of(b), _area(b))
    if not len(s) or not len(t):
        return False
    ax, ay, bx, by = (s[:, None, k] for k in range(4))
    cx, cy, dx, dy = (t[None, :, k] for k in range(4))
    cross = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    return bool(((cross(ax, ay, bx, by, cx, cy) * cross(ax, ay, bx, by, dx, dy) < 0) & (cross(cx, cy, dx, dy, ax, ay) * cross(cx, cy, dx, dy, bx, by) < 0)).any())


def _edge_distance(points: np.ndarray, shape: Shape, close: bool) -> np.ndarray:
    out = np.full(len(points), np.inf)
    for s in _segments(shape, close):
        out = np.minimum(out, segment_distance(points, s[:2], s[2:]))
    return out


def covers(a: dict, b: dict, strict: bool = False) -> bool:
    """Whether a polygon holds all of a geometry; ``strict``: away from its own boundary."""
    if not _area(a):
        return False
    p, q = shape_of(a), shape_of(b)
    v = all_points(q)
    if not len(v):
        return False
    s = _segments(q, _area(b))
    test = np.concatenate([v, (s[:, :2] + s[:, 2:]) / 2])
    edge = _edge_distance(test, p, True) <= 1e-12 * (1 + np.abs(test).max())
    if strict and edge.any():
        return False
    if not (points_inside(test[:, 0], test[:, 1], p) | edge).all() or _crossing(a, b):
        return False
    holes = [[hole] for part in p for hole in part[1:]]
    return not any(points_inside(h[0][:1, 0], h[0][:1, 1], q).any() for h in holes) if _area(b) else True


def contains(a: dict, b: dict) -> bool:
    """Covers, and not only on the boundary."""
    if not covers(a, b):
        return False
    q = shape_of(b)
    s = _segments(q, _area(b))
    test = np.concatenate([all_points(q), (s[:, :2] + s[:, 2:]) / 2])
    return _area(b) or bool((_edge_distance(test, shape_of(a), True) > 1e-12 * (1 + np.abs(test).max())).any())


def touches(a: dict, b: dict) -> bool:
    """They share points, but no inner ones."""
    return intersects(a, b) and not _inner(a, b)


def _inner(a: dict, b: dict) -> bool:
    if _crossing(a, b):
        return True
    p, q = shape_of(a), shape_of(b)
    for shape, value, other, holder in ((q, b, p, a), (p, a, q, b)):
        if not _area(holder):
            continue
        s = _segments(shape, _area(value))
        test = np.concatenate([all_points(shape), (s[:, :2] + s[:, 2:]) / 2, *([representative(shape)[None, :]] if _area(value) else [])])
        far = _edge_distance(test, other, True) > 1e-12 * (1 + np.abs(test).max())
        if (points_inside(test[:, 0], test[:, 1], other) & far).any():
            return True
    return False


def overlaps(a: dict, b: dict) -> bool:
    """Polygons that share an area without one covering the other."""
    return _area(a) and _area(b) and _inner(a, b) and not covers(a, b) and not covers(b, a)


def crosses(a: dict, b: dict) -> bool:
    """A line that is partly inside a polygon, or lines that cross."""
    if _area(a) == _area(b):
        return not _area(a) and _crossing(a, b)
    line, poly = (b, a) if _area(a) else (a, b)
    return _inner(line, poly) and not covers(poly, line)


def distance(a: dict, b: dict) -> float:
    if intersects(a, b):
        return 0.0
    p, q = shape_of(a), shape_of(b)
    va, vb = all_points(p), all_points(q)
    if not len(va) or not len(vb):
        return math.nan
    return float(min(_edge_distance(va, q, _area(b)).min(), _edge_distance(vb, p, _area(a)).min()))


def representative(shape: Shape) -> np.ndarray:
    """A point inside: the middle of the widest stretch on a line through the middle of the box's height."""
    v = all_points(shape)
    y0, y1 = v[:, 1].min(), v[:, 1].max()
    levels = np.unique(v[:, 1])
    y = (y0 + y1) / 2
    if (np.abs(levels - y) < 1e-12).any() and len(levels) > 1:
        k = int(np.searchsorted(levels, y))
        y = (levels[max(0, k - 1)] + levels[min(len(levels) - 1, k)]) / 2 if levels[max(0, k - 1)] != levels[k] else (levels[0] + levels[1]) / 2
    s = _segments(shape, True)
    cut = s[(s[:, 1] > y) != (s[:, 3] > y)]
    if len(cut) < 2:
        return v[0]
    x = np.sort(cut[:, 0] + (y - cut[:, 1]) * (cut[:, 2] - cut[:, 0]) / (cut[:, 3] - cut[:, 1]))
    k = int(np.argmax(x[1::2] - x[0 : len(x) - 1 : 2]))
    return np.array([(x[2 * k] + x[2 * k + 1]) / 2, y])


def invalid_reason(value: dict) -> str:
    """Why a polygon isn't simple and well-formed; 'Valid Geometry' otherwise."""
    shape = shape_of(value)
    if not _area(value):
        return "Valid Geometry" if len(all_points(shape)) else "Empty Geometry"
    for part in shape:
        for ring in part:
            closed = np.vstack([ring, ring[:1]]) if (ring[0] != ring[-1]).any() else ring
            if len(np.unique(closed, axis=0)) < 3:
                return "Too few points in geometry component"
            s = np.hstack([closed[:-1], closed[1:]])
            meet = segments_meet(s, s)
            n = len(s)
            k = np.arange(n)
            meet[k, k] = meet[k, (k + 1) % n] = meet[(k + 1) % n, k] = False
            if meet.any():
                return "Self-intersection"
        for hole in part[1:]:
            if not covers(value_of("Polygon", [[part[0]]]), value_of("Polygon", [[hole]])):
                return "Hole lies outside shell"
    return "Valid Geometry"


def is_simple(value: dict) -> bool:
    shape = shape_of(value)
    for part in shape:
        for ring in part:
            s = np.hstack([ring[:-1], ring[1:]])
            if len(s) < 2:
                continue
            meet = np.triu(segments_meet(s, s), 2)
            if (ring[0] == ring[-1]).all():
                meet[0, -1] = False
            if meet.any():
                return False
    return True


def normalized(value: dict) -> dict:
    """Rings from their least vertex, shells clockwise, holes the other way, parts in order."""

    def ring(r: np.ndarray, clockwise: bool) -> np.ndarray:
        r = r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r
        twice = float(np.dot(r[:, 0], np.roll(r[:, 1], -1)) - np.dot(r[:, 1], np.roll(r[:, 0], -1)))
        r = r[::-1] if (twice < 0) != clockwise else r
        r = np.roll(r, -int(np.lexsort((r[:, 1], r[:, 0]))[0]), axis=0)
        return np.vstack([r, r[:1]])

    if not _area(value):
        return value
    parts = [[ring(r, k == 0) for k, r in enumerate(p)] for p in shape_of(value)]
    return value_of(value["type"], sorted(parts, key=lambda p: p[0].tolist()))


# --- triangles and cells


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (rows of three point numbers) whose circles hold no other point (Bowyer-Watson)."""
    n = len(points)
    if n < 3:
        return np.empty((0, 3), "int64")
    centre, span = points.mean(axis=0), 20 * max(1e-9, float(np.ptp(points, axis=0).max()))
    every = np.vstack([points, centre + [[-span * 3, -span], [span * 3, -span], [0, span * 3]]])
    tri = np.array([[n, n + 1, n + 2]])

    def circles(t: np.ndarray) -> np.ndarray:
        a, b, c = (every[t[:, k]] for k in range(3))
        d = 2 * (a[:, 0] * (b[:, 1] - c[:, 1]) + b[:, 0] * (c[:, 1] - a[:, 1]) + c[:, 0] * (a[:, 1] - b[:, 1]))
        d = np.where(d == 0, 1e-300, d)
        a2, b2, c2 = ((v**2).sum(axis=1) for v in (a, b, c))
        ux = (a2 * (b[:, 1] - c[:, 1]) + b2 * (c[:, 1] - a[:, 1]) + c2 * (a[:, 1] - b[:, 1])) / d
        uy = (a2 * (c[:, 0] - b[:, 0]) + b2 * (a[:, 0] - c[:, 0]) + c2 * (b[:, 0] - a[:, 0])) / d
        return np.stack([ux, uy, (a[:, 0] - ux) ** 2 + (a[:, 1] - uy) ** 2], axis=1)

    ring = circles(tri)
    for k in range(n):
        p = every[k]
        bad = (ring[:, 0] - p[0]) ** 2 + (ring[:, 1] - p[1]) ** 2 < ring[:, 2] * (1 - 1e-12)
        edges = np.sort(np.concatenate([tri[bad][:, [0, 1]], tri[bad][:, [1, 2]], tri[bad][:, [2, 0]]]), axis=1)
        lone, count = np.unique(edges, axis=0, return_counts=True)
        new = np.column_stack([lone[count == 1], np.full(int((count == 1).sum()), k)])
        tri = np.vstack([tri[~bad], new])
        ring = np.vstack([ring[~bad], circles(new)]) if len(new) else ring[~bad]
    return tri[(tri < n).all(axis=1)]


def voronoi(points: np.ndarray) -> list[np.ndarray]:
    """Closed rings of the bounded Voronoi cells, in the order of the points; unbounded ones are left out."""
    spots = np.unique(points, axis=0)
    tri = delaunay(spots)
    outer = set(map(tuple, np.round(hull(spots), 12)))
    cells = []
    for k, p in enumerate(spots):
        mine = tri[(tri == k).any(axis=1)]
        if len(mine) < 3 or tuple(np.round(p, 12)) in outer:
            continue
        a, b, c = (spots[mine[:, j]] for j in range(3))
        d = 2 * (a[:, 0] * (b[:, 1] - c[:, 1]) + b[:, 0] * (c[:, 1] - a[:, 1]) + c[:, 0] * (a[:, 1] - b[:, 1]))
        a2, b2, c2 = ((v**2).sum(axis=1) for v in (a, b, c))
        u = np.stack([(a2 * (b[:, 1] - c[:, 1]) + b2 * (c[:, 1] - a[:, 1]) + c2 * (a[:, 1] - b[:, 1])) / d, (a2 * (c[:, 0] - b[:, 0]) + b2 * (a[:, 0] - c[:, 0]) + c2 * (b[:, 0] - a[:, 0])) / d], axis=1)
        u = u[np.argsort(np.arctan2(u[:, 1] - p[1], u[:, 0] - p[0]))]
        cells.append(np.vstack([u, u[:1]]))
    return cells


def voronoi_faces(points: np.ndarray) -> Shape:
    """The bounded faces between the finite ridges of a Voronoi diagram; of a lattice's corners, what its diagonals leave."""
    spots = np.unique(points, axis=0)
    tri = delaunay(spots)
    if not len(tri):
        return []
    a, b, c = (spots[tri[:, k]] for k in range(3))
    d = 2 * (a[:, 0] * (b[:, 1] - c[:, 1]) + b[:, 0] * (c[:, 1] - a[:, 1]) + c[:, 0] * (a[:, 1] - b[:, 1]))
    a2, b2, c2 = ((v**2).sum(axis=1) for v in (a, b, c))
    centre = np.stack([(a2 * (b[:, 1] - c[:, 1]) + b2 * (c[:, 1] - a[:, 1]) + c2 * (a[:, 1] - b[:, 1])) / d, (a2 * (c[:, 0] - b[:, 0]) + b2 * (a[:, 0] - c[:, 0]) + c2 * (b[:, 0] - a[:, 0])) / d], axis=1)
    beside: dict[tuple[int, int], list[int]] = {}
    for k, t in enumerate(np.sort(tri, axis=1).tolist()):
        for side in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
            beside.setdefault(side, []).append(k)
    ridges = [centre[pair] for pair in beside.values() if len(pair) == 2]
    return overlay.faces([[r] for r in ridges if np.hypot(*(r[1] - r[0])) > 1e-9 * np.abs(spots).max()])


def voronoi_within(points: np.ndarray, bound: Shape) -> list[Shape]:
    """The Voronoi cell of each different place inside bounding polygons, in the order of the places; they fill the bound."""
    spots, rim = np.unique(points, axis=0), all_points(bound)
    low, high = np.minimum(rim.min(axis=0), spots.min(axis=0)) - 1, np.maximum(rim.max(axis=0), spots.max(axis=0)) + 1
    cells = []
    for k, v in enumerate(spots):
        cell = np.array([low, (high[0], low[1]), high, (low[0], high[1]), low])
        for w in spots[np.argsort(np.hypot(*(spots - v).T))][1:]:
            d = w - v
            side = (cell - (v + w) / 2) @ d
            if (side > 0).any():
                cut = [p for p0, p1, s0, s1 in zip(cell[:-1], cell[1:], side[:-1], side[1:], strict=True) for p in ([p0] if s0 <= 0 else []) + ([p0 + (p1 - p0) * s0 / (s0 - s1)] if (s0 <= 0) != (s1 <= 0) else [])]
                cell = overlay.closed(np.array(cut))
        cells.append(overlay.intersection([[cell]], bound))
    return cells


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Part of a ring inside a convex ring, closed; empty if there is none."""
    clip = clip[:-1] if (clip[0] == clip[-1]).all() else clip
    if np.dot(clip[:, 0], np.roll(clip[:, 1], -1)) - np.dot(clip[:, 1], np.roll(clip[:, 0], -1)) < 0:
        clip = clip[::-1]
    out = [tuple(p) for p in (subject[:-1] if (subject[0] == subject[-1]).all() else subject)]
    for a, b in zip(clip, np.roll(clip, -1, axis=0), strict=True):
        side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in out]
        nxt = []
        for k, p in enumerate(out):
            q, sp, sq = out[k - 1], side[k], side[k - 1]
            if (sp >= 0) != (sq >= 0):
                t = sq / (sq - sp)
                nxt.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if sp >= 0:
                nxt.append(p)
        out = nxt
    return np.array([*out, out[0]]) if len(out) > 2 else np.empty((0, 2))


def hilbert(x: np.ndarray, y: np.ndarray, bounds: tuple[float, float, float, float], level: int = 16) -> np.ndarray:
    """Place along a Hilbert curve of 2**level cells a side over the bounds."""
    side = (1 << level) - 1
    left, bottom, right, top = bounds
    i = np.clip((x - left) / max(right - left, 1e-300) * side, 0, side).astype("int64")
    j = np.clip((y - bottom) / max(top - bottom, 1e-300) * side, 0, side).astype("int64")
    out = np.zeros(len(i), "int64")
    for b in range(level - 1, -1, -1):
        rx, ry = (i >> b) & 1, (j >> b) & 1
        out += ((3 * rx) ^ ry) << (2 * b)
        flip = (ry == 0) & (rx == 1)
        i, j = np.where(flip, side - i, i), np.where(flip, side - j, j)
        i, j = np.where(ry == 0, j, i), np.where(ry == 0, i, j)
    return out


# --- bytes


def to_wkb_bytes(value: dict) -> bytes:
    """Little-endian well-known binary."""
    kind, parts = value["type"].lower(), value["parts"] or []
    coords = lambda ring: b"".join(struct.pack("<dd", v["x"], v["y"]) for v in ring)
    line = lambda ring, code=2: struct.pack("<BII", 1, code, len(ring)) + coords(ring)
    poly = lambda p: struct.pack("<BII", 1, 3, len(p)) + b"".join(struct.pack("<I", len(r)) + coords(r) for r in p)
    spot = lambda v: struct.pack("<BI", 1, 1) + struct.pack("<dd", v["x"], v["y"])
    flat = [r for p in parts for r in p]
    if kind == "point":
        return spot(flat[0][0]) if flat and flat[0] else struct.pack("<BIdd", 1, 1, math.nan, math.nan)
    if kind == "linestring":
        return line(flat[0] if flat else [])
    if kind == "polygon":
        return poly(parts[0] if parts else [])
    many = {"multipoint": (4, [spot(v) for r in flat for v in r]), "multilinestring": (5, [line(r) for r in flat]), "multipolygon": (6, [poly(p) for p in parts])}
    code, items = many[kind]
    return struct.pack("<BII", 1, code, len(items)) + b"".join(items)


def from_wkb_bytes(data: bytes) -> dict:
    """A geometry value of well-known binary, either byte order; further ordinates are dropped."""
    at = 0

    def take(fmt: str):
        nonlocal at
        out = struct.unpack_from(fmt, data, at)
        at += struct.calcsize(fmt)
        return out

    def read() -> tuple[int, list]:
        order = "<" if take("B")[0] else ">"
        code = take(f"{order}I")[0]
        if code & 0x20000000:
            take(f"{order}I")
        extra = bool(code & 0x80000000) + bool(code & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}[(code & 0xFFFF) // 1000]
        code = (code & 0xFFFF) % 1000
        vertex = lambda: dict(zip("xy", take(f"{order}{2 + extra}d"), strict=False))
        ring = lambda: [vertex() for _ in range(take(f"{order}I")[0])]
        if code == 1:
            return code, [[[vertex()]]]
        if code == 2:
            return code, [[ring()]]
        if code == 3:
            return code, [[ring() for _ in range(take(f"{order}I")[0])]]
        return code, [p for _ in range(take(f"{order}I")[0]) for p in read()[1]]

    code, parts = read()
    kinds = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
    return {"type": kinds[code], "parts": parts}


# --- column functions

convex_hull = _geometry(lambda g: value_of("Polygon", [[hull(all_points(shape_of(g)))]]))
minimum_rotated_rectangle = _geometry(lambda g: value_of("Polygon", [[rotated_box(all_points(shape_of(g)))]]))
minimum_bounding_radius = _number(lambda g: bounding_circle(all_points(shape_of(g)))[2])
simplify = _geometry(lambda g, t: value_of(g["type"], [[simplify_line(r, t) if len(r) > 2 else r for r in p] for p in shape_of(g)]))
hausdorff_distance = _number(lambda a, b: hausdorff(all_points(shape_of(a)), all_points(shape_of(b))))
frechet_distance = _number(lambda a, b: frechet(all_points(shape_of(a)), all_points(shape_of(b))))
interpolate = _geometry(lambda g, d: value_of("Point", [[along(all_points(shape_of(g)), d)[None, :]]]))
project = _number(lambda g, x, y: project_point(all_points(shape_of(g)), x, y))
representative_point = _geometry(lambda g: value_of("Point", [[representative(shape_of(g))[None, :]]] if len(all_points(shape_of(g))) else []))
normalize = _geometry(normalized)
st_intersects, st_contains, st_touches, st_overlaps, st_crosses = (_flag(f, False) for f in (intersects, contains, touches, overlaps, crosses))
st_disjoint = _flag(lambda a, b: not intersects(a, b), True)
st_covers = _flag(covers, False)
st_covered_by = _flag(lambda a, b: covers(b, a), False)
st_within = _flag(lambda a, b: contains(b, a), False)
st_contains_properly = _flag(lambda a, b: covers(a, b, True), False)
st_distance = _number(distance)
st_dwithin = _flag(lambda a, b, d: distance(a, b) <= d)
st_is_simple = _flag(is_simple)
st_is_valid = _flag(lambda g: invalid_reason(g) == "Valid Geometry")
st_is_valid_reason = _udf(invalid_reason, "string", pa.string())
intersection_convex = _geometry(lambda a, b: value_of("Polygon", [[c]] if len(c := clip_convex(shape_of(a)[0][0], shape_of(b)[0][0])) else []))
delaunay_triangles = _geometry(lambda g: value_of("MultiPolygon", [[v[[*t, t[0]]]] for v in [np.unique(all_points(shape_of(g)), axis=0)] for t in delaunay(v)]))
voronoi_polygons = _geometry(lambda g: value_of("MultiPolygon", [[c] for c in voronoi(all_points(shape_of(g)))]))
to_wkb = _udf(to_wkb_bytes, "binary", pa.binary())
from_wkb = _geometry(from_wkb_bytes)


def hilbert_distance(bounds: tuple[float, float, float, float], level: int = 16):
    """Column function of x and y."""

    @F.arrow_udf("bigint")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(hilbert(x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False), bounds, level))

    return run


# --- overlay


def polygonal(shape: Shape) -> Value:
    return Value("Polygon" if len(shape) == 1 else "MultiPolygon", shape)


def lineal(lines: list[np.ndarray]) -> Value:
    return Value("LineString" if len(lines) == 1 else "MultiLineString", [[line] for line in lines])


def _lines(value: Value) -> bool:
    return "line" in (value.kind or "").lower()


def _clipped(a: Value, b: Value, inside: bool) -> Value:
    """The part of a line or of points inside (or outside) polygons."""
    if _lines(a):
        return lineal([s for p in a.shape for line in p for s in overlay.line_inside(line, b.shape, inside)])
    v = all_points(a.shape)
    kept = v[points_inside(v[:, 0], v[:, 1], b.shape) == inside]
    return Value("Point" if len(kept) == 1 else "MultiPoint", [[p[None, :]] for p in kept])


def _overlaid(rule: Callable[..., Shape]) -> Callable[[Value, Value], Value]:
    def made(a: Value, b: Value) -> Value:
        if _area(a) and _area(b):
            return polygonal(rule(a.shape, b.shape))
        if rule is overlay.intersection and (_area(a) or _area(b)):
            return _clipped(b, a, True) if _area(a) else _clipped(a, b, True)
        if rule is overlay.difference and _area(b):
            return _clipped(a, b, False)
        raise ValueError(f"{rule.__name__} of {a.kind} and {b.kind}")

    return made


def _located(value: Value) -> tuple[Shape, str]:
    return value.shape, value.kind or ""


def _rounded(value: Value, distance: float, quad_segs: int = 16) -> Value:
    return polygonal(overlay.buffer(value.shape, distance, _area(value), int(quad_segs)))


def _circle(value: Value, quad_segs: int = 16) -> Value:
    x, y, r = bounding_circle(all_points(value.shape))
    return polygonal([[overlay.capsule(np.array([x, y]), np.array([x, y]), r, quad_segs)]] if r == r else [])


def _paths(value: tuple) -> Value:
    along_, against = value
    return lineal([*along_, *against])


st_union, st_intersection, st_difference, st_symmetric_difference = (_geometry(_overlaid(f)) for f in (overlay.union, overlay.intersection, overlay.difference, overlay.symmetric_difference))
st_make_valid = _geometry(lambda g: polygonal(overlay.repaired(g.shape)) if _area(g) else g)
st_buffer = _geometry(_rounded)
st_relate = _udf(lambda a, b: overlay.relate(*_located(a), *_located(b)), "string", pa.string())
st_relate_pattern = _flag(lambda a, b, pattern: overlay.matches(overlay.relate(*_located(a), *_located(b)), pattern))
st_equals = _flag(lambda a, b: overlay.matches(overlay.relate(*_located(a), *_located(b)), "T*F**FFF*"), False)
st_is_ring = _flag(lambda g: bool(g.shape) and len(g.shape) == 1 and len(g.shape[0]) == 1 and not _area(g) and len(g.shape[0][0]) > 3 and (g.shape[0][0][0] == g.shape[0][0][-1]).all() and is_simple(g))
st_snap = _geometry(lambda a, b, tolerance: Value(a.kind, [[overlay.snapped(r, all_points(b.shape), tolerance) for r in p] for p in a.shape]))
st_shared_paths = _geometry(lambda a, b: _paths(overlay.shared_paths(a.shape, b.shape, (_area(a), _area(b)))))
st_shortest_line = _geometry(lambda a, b: lineal([n] if len(n := overlay.nearest_places(a.shape, _area(a), b.shape, _area(b))) else []))
st_minimum_clearance = _number(lambda g: overlay.minimum_clearance(g.shape, _area(g)))
st_minimum_bounding_circle = _geometry(_circle)
st_concave_hull = _geometry(lambda g, ratio: polygonal([[overlay.concave_hull(v, delaunay(v), ratio)]] if len(v := np.unique(all_points(g.shape), axis=0)) > 2 else []))
st_offset_curve = _geometry(lambda g, distance: lineal([overlay.offset_line(r, distance) for p in g.shape for r in p if len(r) > 1]))
st_line_merge = _geometry(lambda g: lineal(overlay.merged_lines([r for p in g.shape for r in p])))
st_voronoi_faces = _geometry(lambda g: polygonal(voronoi_faces(all_points(g.shape))))
st_voronoi_within = _geometry(lambda g, bound: polygonal([p for c in voronoi_within(all_points(g.shape), bound.shape) for p in c]))
st_polygonize = _geometry(lambda g: polygonal(overlay.faces(g.shape)))
st_build_area = _geometry(lambda g: polygonal(overlay.enclosed(g.shape)))
