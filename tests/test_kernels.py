from __future__ import annotations

import math

import numpy as np
import pytest

from strataframe.functions import kernels as K


def square(x, y, s, hole=None):
    ring = lambda a, b, c: [{"x": a + u * c, "y": b + v * c} for u, v in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    return {"type": "Polygon", "parts": [[ring(x, y, s), *([ring(*hole)] if hole else [])]]}


def line(*v):
    return {"type": "LineString", "parts": [[[{"x": float(a), "y": float(b)} for a, b in v]]]}


def test_relations():
    big, ring = square(0.0, 0.0, 10.0), square(0.0, 0.0, 10.0, (4.0, 4.0, 2.0))
    assert K.contains(big, square(1.0, 1.0, 2.0)) and not K.contains(ring, square(3.0, 3.0, 4.0)) and not K.intersects(ring, square(4.5, 4.5, 1.0))
    assert K.touches(big, square(10.0, 0.0, 3.0)) and not K.touches(big, square(9.0, 0.0, 3.0)) and K.overlaps(big, square(9.0, 0.0, 3.0))
    assert K.crosses(line((-1, 5), (11, 5)), big) and not K.crosses(line((1, 5), (9, 5)), big) and K.crosses(line((0, 0), (2, 2)), line((0, 2), (2, 0)))
    assert not K.intersects(big, {"type": "Polygon", "parts": []}) and K.covers(big, big) and not K.covers(big, big, True)
    assert K.distance(square(0.0, 0.0, 1.0), square(4.0, 5.0, 1.0)) == 5.0


def test_validity():
    bow = {"type": "Polygon", "parts": [[[{"x": float(a), "y": float(b)} for a, b in ((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))]]]}
    assert K.invalid_reason(bow) == "Self-intersection" and not K.is_simple(bow) and K.invalid_reason(square(0.0, 0.0, 1.0)) == "Valid Geometry"
    assert K.invalid_reason(square(0.0, 0.0, 1.0, (5.0, 5.0, 1.0))) == "Hole lies outside shell"


def test_circle_and_hull_hold_all():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50):
        p = rng.normal(size=(n, 2))
        x, y, r = K.bounding_circle(p)
        assert (np.hypot(p[:, 0] - x, p[:, 1] - y) <= r + 1e-9).all()
    assert K.bounding_circle(np.array([[0.0, 0], [2, 0], [1, 0]]))[2] == pytest.approx(1.0)


def test_triangles_have_empty_circles_and_cells_meet():
    p = np.random.default_rng(1).uniform(size=(40, 2))
    tri = K.delaunay(p)
    area = sum(abs(np.cross(np.append(p[b] - p[a], 0), np.append(p[c] - p[a], 0))[2]) / 2 for a, b, c in tri)
    h = K.hull(p)
    assert area == pytest.approx(abs(np.dot(h[:-1, 0], h[1:, 1]) - np.dot(h[:-1, 1], h[1:, 0])) / 2)
    golden = np.array([(x + u, y + v) for x, y in ((10, 10), (5, 5)) for u, v in ((0, 0), (1, 0), (1, 1), (0, 1))], float)
    assert len(K.voronoi(golden)) == 2


def test_lines():
    v = np.array([[0.0, 0], [3, 0], [3, 4]])
    assert K.along(v, 5).tolist() == [3, 2] and K.along(v, -1).tolist() == [3, 3] and K.along(v, 0.5, True).tolist() == [3, 0.5]
    assert K.project_point(v, 5, 1) == 4.0 and K.frechet(v, v) == 0 and math.isnan(K.hausdorff(v, np.empty((0, 2))))
    assert K.simplify_line(np.array([[0.0, 0], [1, 0.01], [2, 0], [2, 2]]), 0.1).tolist() == [[0, 0], [2, 0], [2, 2]]


def test_hilbert_is_a_curve():
    g = np.stack(np.meshgrid(np.arange(8.0), np.arange(8.0)), -1).reshape(-1, 2)
    h = K.hilbert(g[:, 0], g[:, 1], (0, 0, 7, 7), 3)
    assert sorted(h) == list(range(64)) and (np.abs(np.diff(g[np.argsort(h)], axis=0)).sum(axis=1) == 1).all()


def test_bytes_round_trip():
    for g in (square(0.0, 1.0, 2.0, (0.5, 1.5, 0.2)), line((0, 1), (2, 3)), {"type": "Point", "parts": [[[{"x": 1.0, "y": 2.0}]]]}, {"type": "MultiPolygon", "parts": square(0.0, 0.0, 1.0)["parts"] * 2}):
        assert K.from_wkb_bytes(K.to_wkb_bytes(g)) == g
