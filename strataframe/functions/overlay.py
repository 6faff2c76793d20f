"""Boolean operations, buffers and topology of shapes, on arrangements of line segments in numpy.

All segments of the shapes are cut where they meet. A piece belongs to the boundary of the result if the rule of the
operation differs on its two sides, which is asked just beside its middle. The kept pieces, each with the result on its
left, are walked into rings. The same pieces answer relations (DE-9IM), and give shared paths and faces.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Sequence

import numpy as np

from strataframe.functions.shapes import Shape, points_inside

#: Coordinates that are this part of the extent apart are one, and sides are asked this part of a piece away from it.
SNAP, BESIDE = 1e-11, 1e-6


def closed(ring: np.ndarray) -> np.ndarray:
    return ring if len(ring) < 2 or (ring[0] == ring[-1]).all() else np.vstack([ring, ring[:1]])


def ring_area(ring: np.ndarray) -> float:
    """Signed, counter-clockwise positive."""
    r = closed(ring) - ring[0]
    return float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum() / 2)


def segments_of(shape: Shape, close: bool = True) -> np.ndarray:
    """Rows (x, y, x, y); rings are closed if asked."""
    out = [np.hstack([r[:-1], r[1:]]) for part in shape for ring in part for r in [closed(ring) if close else ring] if len(r) > 1]
    return np.concatenate(out) if out else np.empty((0, 4))


# --- arrangements


class Nodes:
    """Numbers places; those closer than the tolerance get one number."""

    def __init__(self, tolerance: float):
        self.step = max(tolerance, 1e-300)
        self.at: dict[tuple[int, int], int] = {}
        self.xy: list[tuple[float, float]] = []

    def add(self, x: float, y: float) -> int:
        i, j = math.floor(x / self.step), math.floor(y / self.step)
        for a in (i, i - 1, i + 1):
            for b in (j, j - 1, j + 1):
                k = self.at.get((a, b))
                if k is not None and abs(self.xy[k][0] - x) <= self.step and abs(self.xy[k][1] - y) <= self.step:
                    return k
        self.at[i, j] = len(self.xy)
        self.xy.append((x, y))
        return len(self.xy) - 1


def _meetings(s: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, x, y) of all places inside or at the ends of segments where another one meets them."""
    low, high = np.minimum(s[:, :2], s[:, 2:]) - tolerance, np.maximum(s[:, :2], s[:, 2:]) + tolerance
    number, places = [], []
    step = max(1, (1 << 22) // max(1, len(s)))
    for k in range(0, len(s), step):
        part = slice(k, k + step)
        near = (low[part, None, 0] <= high[None, :, 0]) & (low[None, :, 0] <= high[part, None, 0]) & (low[part, None, 1] <= high[None, :, 1]) & (low[None, :, 1] <= high[part, None, 1])
        a, b = np.nonzero(near)
        a = a + k
        a, b = a[a < b], b[a < b]
        p, r, q, t = s[a, :2], s[a, 2:] - s[a, :2], s[b, :2], s[b, 2:] - s[b, :2]
        cross = r[:, 0] * t[:, 1] - r[:, 1] * t[:, 0]
        size = np.hypot(*r.T) * np.hypot(*t.T)
        gap = q - p
        slant = np.abs(cross) > 1e-14 * size
        with np.errstate(divide="ignore", invalid="ignore"):
            u = (gap[:, 0] * t[:, 1] - gap[:, 1] * t[:, 0]) / cross
            v = (gap[:, 0] * r[:, 1] - gap[:, 1] * r[:, 0]) / cross
        su, sv = tolerance / np.maximum(np.hypot(*r.T), 1e-300), tolerance / np.maximum(np.hypot(*t.T), 1e-300)
        hit = slant & (u >= -su) & (u <= 1 + su) & (v >= -sv) & (v <= 1 + sv)
        spot = p[hit] + u[hit, None] * r[hit]
        number += [a[hit], b[hit]]
        places += [spot, spot]
        for one, other in ((a, b), (b, a)):  # ends that lie on the other segment
            for end in (slice(0, 2), slice(2, 4)):
                e = s[one, end]
                d = s[other, 2:] - s[other, :2]
                square = np.maximum((d**2).sum(axis=1), 1e-300)
                w = np.clip(((e - s[other, :2]) * d).sum(axis=1) / square, 0, 1)
                off = np.hypot(*(s[other, :2] + w[:, None] * d - e).T)
                on = off <= tolerance
                number.append(other[on])
                places.append(e[on])
    xy = np.concatenate(places) if places else np.empty((0, 2))
    return np.concatenate(number) if number else np.empty(0, "int64"), xy[:, 0], xy[:, 1]


def pieces(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (n, 2), different undirected pieces (m, 2) between them, and for each segment's pieces (segment, from, to)."""
    if not len(segments):
        return np.empty((0, 2)), np.empty((0, 2), "int64"), np.empty((0, 3), "int64")
    extent = float(np.abs(segments).max())
    tolerance = SNAP * max(extent, 1e-300)
    nodes = Nodes(tolerance)
    ends = [(nodes.add(x0, y0), nodes.add(x1, y1)) for x0, y0, x1, y1 in segments.tolist()]
    stops: dict[int, set[int]] = defaultdict(set)
    for k, x, y in zip(*(v.tolist() for v in _meetings(segments, tolerance)), strict=True):
        stops[k].add(nodes.add(x, y))
    xy = np.array(nodes.xy)
    walk = []
    for k, (a, b) in enumerate(ends):
        if a == b:
            continue
        d = xy[b] - xy[a]
        order = sorted(stops[k] - {a, b}, key=lambda n: float((xy[n] - xy[a]) @ d))
        order = [n for n in order if 0 < float((xy[n] - xy[a]) @ d) < float(d @ d)]
        walk += [(k, u, v) for u, v in zip([a, *order], [*order, b], strict=True) if u != v]
    walk = np.array(walk, dtype="int64").reshape(-1, 3)
    return xy, np.unique(np.sort(walk[:, 1:], axis=1), axis=0), walk


def _sides(xy: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places just to the left and to the right of the middle of each piece."""
    a, b = xy[edges[:, 0]], xy[edges[:, 1]]
    d = b - a
    beside = np.stack([-d[:, 1], d[:, 0]], axis=1) * BESIDE
    return (a + b) / 2 + beside, (a + b) / 2 - beside


def _turns(xy: np.ndarray, links: list[tuple[int, int]]) -> list[list[int]]:
    """Rings of node numbers: directed links walked with the leftmost turn at every node, cut at nodes met twice."""
    out: dict[int, list[int]] = defaultdict(list)
    for k, (u, _) in enumerate(links):
        out[u].append(k)
    free = [True] * len(links)
    rings = []
    for start in range(len(links)):
        if not free[start]:
            continue
        path, seen, k = [], {}, start
        while k is not None and free[k]:
            free[k] = False
            u, v = links[k]
            if u in seen:
                rings.append(path[seen[u] :])
                for n in path[seen[u] :]:
                    seen.pop(n, None)
                path = path[: len(path) - len(rings[-1])]
            seen[u] = len(path)
            path.append(u)
            back = xy[u] - xy[v]
            best, k = None, None
            for n in out[v]:
                if free[n]:
                    ahead = xy[links[n][1]] - xy[v]
                    turn = math.atan2(float(back[0] * ahead[1] - back[1] * ahead[0]), float(back @ ahead)) % (2 * math.pi)
                    turn = turn if turn < 2 * math.pi - 1e-12 else 0.0  # straight back comes last
                    if best is None or turn > best:
                        best, k = turn, n
            if v in seen:
                rings.append(path[seen[v] :])
                cut = rings[-1]
                path = path[: len(path) - len(cut)]
                for n in cut:
                    seen.pop(n, None)
    return [r for r in rings if len(r) > 2]


def _assembled(xy: np.ndarray, rings: list[list[int]], corners: set[tuple[float, float]] | None = None) -> Shape:
    """Polygons of rings: counter-clockwise ones are shells, the others holes of the least shell that holds them."""
    shells, holes = [], []
    for ring in rings:
        r = xy[np.array(ring)]
        if corners is not None and len(r) > 3:  # places at which nothing turns and no input had a vertex
            before, after = r - np.roll(r, 1, axis=0), np.roll(r, -1, axis=0) - r
            flat = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]) <= 1e-12 * np.maximum(np.hypot(*before.T) * np.hypot(*after.T), 1e-300)
            keep = [not f or tuple(p) in corners for f, p in zip(flat, r.tolist(), strict=True)]
            r = r[np.array(keep)] if sum(keep) > 2 else r
        area = ring_area(r)
        if area:
            (shells if area > 0 else holes).append((abs(area), closed(r)))
    shells.sort(key=lambda s: s[0])
    shape = [[r] for _, r in shells]
    for _, hole in sorted(holes, key=lambda h: -h[0]):
        middle = (hole[0] + hole[1]) / 2
        d = hole[1] - hole[0]
        x, y = middle + np.array([-d[1], d[0]]) * BESIDE  # on the result's side of the hole's edge
        for k, (_, shell) in enumerate(shells):
            if points_inside(np.array([x]), np.array([y]), [[shell]])[0]:
                shape[k].append(hole)
                break
    return shape


def combine(shapes: Sequence[Shape], rule: Callable[[np.ndarray], np.ndarray]) -> Shape:
    """Polygons of the places for which ``rule`` holds; it gets a row per shape that says which places are inside."""
    parts = [segments_of(s) for s in shapes]
    every = np.concatenate(parts) if parts else np.empty((0, 4))
    if not len(every):
        return []
    xy, edges, _ = pieces(every)
    left, right = (rule(np.stack([points_inside(p[:, 0], p[:, 1], s) for s in shapes])) for p in _sides(xy, edges))
    links = [(int(u), int(v)) if a else (int(v), int(u)) for (u, v), a, b in zip(edges, left, right, strict=True) if a != b]
    corners = {tuple(p) for p in every.reshape(-1, 2).tolist()}
    return _assembled(xy, _turns(xy, links), corners)


def union(*shapes: Shape) -> Shape:
    return combine(shapes, lambda held: held.any(axis=0))


def intersection(*shapes: Shape) -> Shape:
    return combine(shapes, lambda held: held.all(axis=0))


def difference(a: Shape, *others: Shape) -> Shape:
    return combine([a, *others], lambda held: held[0] & ~held[1:].any(axis=0))


def symmetric_difference(a: Shape, b: Shape) -> Shape:
    return combine([a, b], lambda held: held[0] ^ held[1])


def union_all(shapes: Sequence[Shape], batch: int = 8) -> Shape:
    """Union of many, a few at a time."""
    todo = [s for s in shapes if s]
    while len(todo) > 1:
        todo = [union(*todo[k : k + batch]) for k in range(0, len(todo), batch)]
    return todo[0] if todo else []


def repaired(shape: Shape) -> Shape:
    """Valid polygons of what rings that cross themselves enclose an odd number of times."""
    rings = [[[r]] for part in shape for r in part if len(r) > 2]
    return combine(rings, lambda held: held.sum(axis=0) % 2 == 1) if rings else []


# --- buffers


def _arc(centre: np.ndarray, distance: float, start: float, sweep: float, quad_segs: int) -> list[tuple[float, float]]:
    """Places on a circle from an angle on, counter-clockwise, at multiples of a quarter by ``quad_segs`` and both ends."""
    step = math.pi / 2 / quad_segs
    first, last = math.ceil(start / step + 1e-9), math.floor((start + sweep) / step - 1e-9)
    angles = [start, *[k * step for k in range(first, last + 1)], start + sweep]
    return [(float(centre[0] + distance * math.cos(a)), float(centre[1] + distance * math.sin(a))) for a in angles]


def capsule(a: np.ndarray, b: np.ndarray, distance: float, quad_segs: int = 16) -> np.ndarray:
    """All places within a distance of a segment, or of a place."""
    if (a == b).all():
        return closed(np.array(_arc(a, distance, 0.0, 2 * math.pi, quad_segs)[:-1]))
    d = b - a
    side = math.atan2(-d[0], d[1])  # the angle of the right-hand normal
    return closed(np.array(_arc(b, distance, side, math.pi, quad_segs) + _arc(a, distance, side + math.pi, math.pi, quad_segs)))


def _convex(ring: np.ndarray) -> bool:
    r = closed(ring)[:-1]
    before, after = r - np.roll(r, 1, axis=0), np.roll(r, -1, axis=0) - r
    turn = before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]
    return bool((turn > 0).all() or (turn < 0).all()) and abs(ring_area(r)) > 0


def _grown(ring: np.ndarray, distance: float, quad_segs: int) -> np.ndarray:
    """A convex ring moved outwards, with arcs at its corners."""
    r = closed(ring)[:-1]
    r = r if ring_area(r) > 0 else r[::-1]
    out = []
    for before, here, after in zip(np.roll(r, 1, axis=0), r, np.roll(r, -1, axis=0), strict=True):
        u, v = here - before, after - here
        start = math.atan2(-u[0], u[1])
        out += _arc(here, distance, start, (math.atan2(-v[0], v[1]) - start) % (2 * math.pi), quad_segs)
    return closed(np.array(out))


def buffer(shape: Shape, distance: float, area: bool = True, quad_segs: int = 16) -> Shape:
    """All places within ``distance`` of a shape; of polygons (``area``) a negative one leaves what is deeper inside."""
    if distance == 0 or not shape:
        return shape if area else []
    if area and distance > 0 and len(shape) == 1 and len(shape[0]) == 1 and _convex(shape[0][0]):
        return [[_grown(shape[0][0], distance, quad_segs)]]
    if not area and distance < 0:
        return []
    lines = segments_of(shape, area)
    lone = [np.hstack([r[0], r[0]]) for part in shape for r in part if len(r) == 1]
    lines = np.vstack([lines, *lone]) if lone else lines
    rims = [[[capsule(s[:2], s[2:], abs(distance), quad_segs)]] for s in lines]
    if distance < 0:
        return difference(shape, union_all(rims))
    return union_all([*([shape] if area else []), *rims])


def offset_line(line: np.ndarray, distance: float, quad_segs: int = 8) -> np.ndarray:
    """A line's parallel at a distance to its left (negative: to its right), with arcs around outer corners."""
    out: list[tuple[float, float]] = []
    steps = [(a, b) for a, b in zip(line[:-1], line[1:], strict=True) if (a != b).any()]
    sign = 1.0 if distance >= 0 else -1.0
    for k, (a, b) in enumerate(steps):
        d = (b - a) / np.hypot(*(b - a))
        normal = np.array([-d[1], d[0]]) * distance
        if k:
            turn = before[0] * d[1] - before[1] * d[0]
            if turn * sign < -1e-15:  # outer corner
                start, end = math.atan2(*(np.array([-before[1], before[0]]) * sign)[::-1]), math.atan2(*(np.array([-d[1], d[0]]) * sign)[::-1])
                sweep = (start - end) % (2 * math.pi) if sign > 0 else (end - start) % (2 * math.pi)
                arc = _arc(a, abs(distance), end if sign > 0 else start, sweep, quad_segs)
                out += arc[::-1][1:] if sign > 0 else arc[1:]
            elif turn * sign > 1e-15:  # inner corner: where the parallels meet
                out[-1] = tuple((a + (normal + np.array([-before[1], before[0]]) * distance) / (1 + float(before @ d))).tolist())
        else:
            out.append(tuple((a + normal).tolist()))
        out.append(tuple((b + normal).tolist()))
        before = d
    return np.array(out).reshape(-1, 2)


# --- relations


def _locate(points: np.ndarray, shape: Shape, kind: str, tolerance: float) -> np.ndarray:
    """0 interior, 1 boundary, 2 exterior of each place."""
    if not len(points):
        return np.empty(0, "int64")
    if "point" in kind:
        spots = np.concatenate([r for p in shape for r in p]) if shape else np.empty((0, 2))
        near = (np.hypot(points[:, None, 0] - spots[None, :, 0], points[:, None, 1] - spots[None, :, 1]) <= tolerance).any(axis=1) if len(spots) else np.zeros(len(points), bool)
        return np.where(near, 0, 2)
    s = segments_of(shape, "polygon" in kind)
    d = s[:, 2:] - s[:, :2]
    square = np.maximum((d**2).sum(axis=1), 1e-300)
    gap = points[:, None, :] - s[None, :, :2]
    w = np.clip((gap * d[None]).sum(axis=2) / square[None], 0, 1)
    on = (np.hypot(*np.moveaxis(gap - w[..., None] * d[None], 2, 0)) <= tolerance).any(axis=1) if len(s) else np.zeros(len(points), bool)
    if "polygon" in kind:
        return np.where(on, 1, np.where(points_inside(points[:, 0], points[:, 1], shape), 0, 2))
    ends = [r[k] for p in shape for r in p if len(r) > 1 and (r[0] != r[-1]).any() for k in (0, -1)]
    count = sum(np.hypot(points[:, 0] - e[0], points[:, 1] - e[1]) <= tolerance for e in ends) if ends else np.zeros(len(points), int)
    return np.where(on, np.where(np.asarray(count) % 2 == 1, 1, 0), 2)


def relate(a: Shape, kind_a: str, b: Shape, kind_b: str) -> str:
    """DE-9IM of two shapes: dimensions of what interiors, boundaries and exteriors share, as nine letters."""
    shapes = [(a, kind_a.lower()), (b, kind_b.lower())]
    every = np.concatenate([segments_of(s, "polygon" in k) for s, k in shapes])
    spots = [r for s, k in shapes for p in s for r in p if len(r) == 1]
    extent = max([1e-300, *(float(np.abs(v).max()) for v in [every, *spots] if len(v))])
    tolerance = 10 * SNAP * extent
    xy, edges, _ = pieces(every)
    xy = np.vstack([xy, *spots]) if spots else xy
    matrix = np.full((3, 3), -1)
    matrix[2, 2] = 2
    middle = (xy[edges[:, 0]] + xy[edges[:, 1]]) / 2 if len(edges) else np.empty((0, 2))
    faces = np.vstack(_sides(xy, edges)) if len(edges) else np.empty((0, 2))
    for dimension, places in ((0, xy), (1, middle), (2, faces)):
        i, j = (_locate(places, s, k, tolerance) for s, k in shapes)
        if dimension == 2:  # beside a piece lies no boundary
            keep = (i != 1) & (j != 1)
            lined = [("line" in k) or ("point" in k) for _, k in shapes]
            i, j = np.where(lined[0], 2, i)[keep], np.where(lined[1], 2, j)[keep]
        np.maximum.at(matrix, (i, j), dimension)
    return "".join("F" if v < 0 else str(v) for v in matrix.ravel().tolist())


def matches(found: str, pattern: str) -> bool:
    """Whether a DE-9IM matches a pattern of 0, 1, 2, T, F and *."""
    return len(pattern) == 9 and all(p == "*" or (p == "T" and f != "F") or p == f for f, p in zip(found, pattern.upper(), strict=True))


# --- lines


def merged_lines(lines: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Lines joined at ends where exactly two meet."""
    links = [[tuple(p) for p in line.tolist()] for line in lines if len(line) > 1]
    ends: dict[tuple, list[int]] = defaultdict(list)
    for k, line in enumerate(links):
        ends[line[0]].append(k)
        ends[line[-1]].append(k)
    used, out = [False] * len(links), []

    def grow(path: list) -> list:
        while len(at := ends[path[-1]]) == 2:
            free = [k for k in at if not used[k]]
            if not free:
                break
            used[free[0]] = True
            line = links[free[0]]
            path += line[1:] if line[0] == path[-1] else line[-2::-1]
        return path

    for k, line in enumerate(links):
        if not used[k]:
            used[k] = True
            out.append(np.array(grow(grow(list(line))[::-1])[::-1]))
    return out


def shared_paths(a: Shape, b: Shape, close: tuple[bool, bool] = (False, False)) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pieces that both shapes run along, in the same and in the opposite direction."""
    first, second = segments_of(a, close[0]), segments_of(b, close[1])
    if not len(first) or not len(second):
        return [], []
    xy, _, walk = pieces(np.concatenate([first, second]))
    mine, others = walk[walk[:, 0] < len(first), 1:].tolist(), {tuple(w) for w in walk[walk[:, 0] >= len(first), 1:].tolist()}
    with_, against = ([xy[[u, v]] for u, v in mine if ((u, v) if way else (v, u)) in others] for way in (True, False))
    return merged_lines(with_), merged_lines(against)


def snapped(ring: np.ndarray, spots: np.ndarray, tolerance: float) -> np.ndarray:
    """Vertices moved to the nearest of some places within a tolerance."""
    if not len(spots) or not len(ring):
        return ring
    d = np.hypot(ring[:, None, 0] - spots[None, :, 0], ring[:, None, 1] - spots[None, :, 1])
    near = d.argmin(axis=1)
    return np.where((d.min(axis=1) <= tolerance)[:, None], spots[near], ring)


def faces(lines: Shape) -> Shape:
    """The bounded faces between lines, each a polygon; what ends openly is left out."""
    xy, edges, _ = pieces(segments_of(lines, False))
    edges = edges.tolist()
    while True:  # dangling pieces bound nothing
        degree: dict[int, int] = defaultdict(int)
        for u, v in edges:
            degree[u] += 1
            degree[v] += 1
        kept = [(u, v) for u, v in edges if degree[u] > 1 and degree[v] > 1]
        if len(kept) == len(edges):
            break
        edges = kept
    return _assembled(xy, _turns(xy, [*map(tuple, edges), *[(v, u) for u, v in edges]])) if edges else []


def enclosed(lines: Shape) -> Shape:
    """The area that lines enclose, by the even-odd rule of its faces."""
    return union_all([[p] for p in faces(lines)]) if not any(len(p) > 1 for p in faces(lines)) else repaired([[r] for p in faces(lines) for r in p[:1]])


def nearest_places(a: Shape, area_a: bool, b: Shape, area_b: bool) -> np.ndarray:
    """The ends of a shortest line between two shapes, the first on ``a``; one place twice where they meet."""
    va, vb = (np.concatenate([r for p in s for r in p]) if s else np.empty((0, 2)) for s in (a, b))
    if not len(va) or not len(vb):
        return np.empty((0, 2))
    for points, shape, area in ((va, b, area_b), (vb, a, area_a)):
        if area and (held := points_inside(points[:, 0], points[:, 1], shape)).any():
            return np.repeat(points[held][:1], 2, axis=0)
    sa, sb = (np.vstack([segments_of(s, area), *[np.hstack([r[0], r[0]]) for p in s for r in p if len(r) == 1]]) for s, area in ((a, area_a), (b, area_b)))
    hit, x, y = _meetings(np.vstack([sa, sb]), SNAP * float(np.abs(np.vstack([sa, sb])).max()))
    first = {(u, v) for k, u, v in zip(hit.tolist(), x.tolist(), y.tolist(), strict=True) if k < len(sa)}
    both = [(u, v) for k, u, v in zip(hit.tolist(), x.tolist(), y.tolist(), strict=True) if k >= len(sa) and (u, v) in first]
    if both:
        return np.array([both[0], both[0]])
    best, out = math.inf, np.empty((0, 2))
    for points, s, swap in ((va, sb, False), (vb, sa, True)):
        d = s[:, 2:] - s[:, :2]
        gap = points[:, None, :] - s[None, :, :2]
        w = np.clip((gap * d[None]).sum(axis=2) / np.maximum((d**2).sum(axis=1), 1e-300)[None], 0, 1)
        spot = s[None, :, :2] + w[..., None] * d[None]
        far = np.hypot(*np.moveaxis(points[:, None, :] - spot, 2, 0))
        i, j = np.unravel_index(int(far.argmin()), far.shape)
        if far[i, j] < best:
            best = far[i, j]
            out = np.array([spot[i, j], points[i]] if swap else [points[i], spot[i, j]])
    return out


def minimum_clearance(shape: Shape, close: bool = True) -> float:
    """Least distance by which a vertex can move so that the shape becomes invalid: to other vertices and to segments not at it."""
    v = np.unique(np.concatenate([r for p in shape for r in p]), axis=0) if shape else np.empty((0, 2))
    s = segments_of(shape, close)
    if len(v) < 2:
        return math.inf
    d = np.hypot(v[:, None, 0] - v[None, :, 0], v[:, None, 1] - v[None, :, 1])
    np.fill_diagonal(d, np.inf)
    best = float(d.min())
    for a, b in zip(s[:, :2], s[:, 2:], strict=True):
        away = ~((v == a).all(axis=1) | (v == b).all(axis=1))
        if away.any():
            step = b - a
            t = np.clip(((v[away] - a) @ step) / max(float(step @ step), 1e-300), 0, 1)
            best = min(best, float(np.hypot(*(a + t[:, None] * step - v[away]).T).min()))
    return best


def concave_hull(points: np.ndarray, triangles: np.ndarray, ratio: float = 0.0) -> np.ndarray:
    """Closed ring around points: border triangles with long border sides are taken off their triangulation.

    ``ratio`` 1 leaves the convex hull; 0 takes off all that leave every point on or inside the ring.
    """
    sides: dict[tuple[int, int], list[int]] = defaultdict(list)
    for k, t in enumerate(triangles.tolist()):
        for u, v in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            sides[min(u, v), max(u, v)].append(k)
    length = {e: float(np.hypot(*(points[e[0]] - points[e[1]]))) for e in sides}
    if not length:
        return points
    limit = min(length.values()) + ratio * (max(length.values()) - min(length.values()))
    alive = set(range(len(triangles)))
    border = {e for e, t in sides.items() if len(t) == 1}
    on_border = {n for e in border for n in e}
    while True:
        long = [e for e in border if length[e] > limit]
        done = True
        for e in sorted(long, key=lambda e: -length[e]):
            k = next(t for t in sides[e] if t in alive)
            tip = next(n for n in triangles[k].tolist() if n not in e)
            if tip in on_border:
                continue
            alive.discard(k)
            border.discard(e)
            border |= {(min(n, tip), max(n, tip)) for n in e}
            on_border.add(tip)
            done = False
            break
        if done:
            break
    links: dict[int, list[int]] = defaultdict(list)
    for u, v in border:
        links[u].append(v)
        links[v].append(u)
    start = next(iter(border))[0]
    ring, last, here = [start], None, start
    while (nxt := next((n for n in links[here] if n != last), None)) not in (None, start) and len(ring) <= len(border):
        ring.append(nxt)
        last, here = here, nxt
    out = closed(points[np.array(ring)])
    return out if ring_area(out) > 0 else out[::-1]


def line_inside(line: np.ndarray, shape: Shape, inside: bool = True) -> list[np.ndarray]:
    """The stretches of a line inside (or outside) polygons."""
    own, rim = segments_of([[line]], False), segments_of(shape)
    if not len(own):
        return []
    xy, _, walk = pieces(np.vstack([own, rim]))
    mine = walk[walk[:, 0] < len(own)]
    middle = (xy[mine[:, 1]] + xy[mine[:, 2]]) / 2
    held = points_inside(middle[:, 0], middle[:, 1], shape) == inside
    return merged_lines([xy[[u, v]] for (_, u, v), h in zip(mine.tolist(), held, strict=True) if h])
