"""Boolean operations, buffers and relations against sums of areas and known results."""

from __future__ import annotations

import math

import numpy as np
import pytest

from strataframe.functions import overlay as O
from strataframe.functions.kernels import delaunay
from strataframe.functions.shapes import points_inside


def square(x, y, s=1.0):
    return [[np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)], dtype="float64")]]


def star(rng, n=9, size=5.0):
    angle = np.sort(rng.uniform(0, 2 * math.pi, n))
    r = rng.uniform(1, size, n)
    c = rng.uniform(-2, 2, 2)
    return [[np.stack([c[0] + r * np.cos(angle), c[1] + r * np.sin(angle)], axis=1)]]


def area(shape):
    return sum(abs(O.ring_area(p[0])) - sum(abs(O.ring_area(h)) for h in p[1:]) for p in shape)


@pytest.mark.parametrize("seed", range(12))
def test_random_polygons(seed):
    rng = np.random.default_rng(seed)
    a, b = star(rng), star(rng)
    both, one, less, more = O.intersection(a, b), O.union(a, b), O.difference(a, b), O.symmetric_difference(a, b)
    assert area(one) == pytest.approx(area(a) + area(b) - area(both))
    assert area(less) == pytest.approx(area(a) - area(both))
    assert area(more) == pytest.approx(area(one) - area(both))
    p = rng.uniform(-7, 7, (4000, 2))
    held = [points_inside(p[:, 0], p[:, 1], s) for s in (a, b, both, one, less, more)]
    assert (held[2] == (held[0] & held[1])).all() and (held[3] == (held[0] | held[1])).all()
    assert (held[4] == (held[0] & ~held[1])).all() and (held[5] == (held[0] ^ held[1])).all()


def test_touching_equal_nested_and_empty():
    assert area(O.union(square(0, 0), square(1, 0))) == 2 and len(O.union(square(0, 0), square(1, 0))) == 1
    assert len(O.union(square(0, 0), square(1, 1))) == 2 and O.intersection(square(0, 0), square(1, 0)) == []
    same = O.union(square(0, 0), square(0, 0))
    assert area(same) == 1 and len(same[0][0]) == 5
    ring = O.difference(square(0, 0, 5), square(1, 1))
    assert len(ring) == 1 and len(ring[0]) == 2 and area(ring) == 24
    assert O.difference(square(0, 0), square(-1, -1, 5)) == [] and O.union([], square(0, 0)) and O.intersection([], square(0, 0)) == []
    holed = O.difference(square(0, 0, 4), square(1, 0, 1))  # a notch that touches the edge
    assert area(holed) == 15 and len(holed[0]) == 1
    corner = O.difference(square(0, 0, 4), [[np.array([(0.0, 0), (2, 1), (1, 2), (0, 0)])]])  # a hole that touches the shell in one place
    assert area(corner) == pytest.approx(16 - 1.5) and len(corner) == 1 and len(corner[0]) == 2


def test_unions_of_many_and_repair():
    assert area(O.union_all([square(k * 0.5, 0) for k in range(40)])) == pytest.approx(20.5)
    bow = [[np.array([(0.0, 0), (2, 2), (2, 0), (0, 2)])]]
    assert area(O.repaired(bow)) == pytest.approx(2) and len(O.repaired(bow)) == 2


def test_buffers():
    grown = O.buffer(square(0, 0, 10), 2)
    assert area(grown) == pytest.approx(100 + 80 + math.pi * 4, rel=1e-3)
    assert area(O.buffer(square(0, 0, 10), -2)) == pytest.approx(36)
    assert O.buffer(square(0, 0, 2), -2) == []
    line = [[np.array([(0.0, 0), (10, 0), (10, 10)])]]
    assert area(O.buffer(line, 1, area=False)) == pytest.approx(20 + 20 - 1 + math.pi + math.pi / 4, rel=2e-3)
    cross = [[np.array([(0.0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)])]]
    made = O.buffer(cross, 0.5)
    p = np.random.default_rng(0).uniform(-1, 7, (3000, 2))
    s = O.segments_of(cross)
    d = s[:, 2:] - s[:, :2]
    w = np.clip(((p[:, None] - s[None, :, :2]) * d[None]).sum(axis=2) / (d**2).sum(axis=1), 0, 1)
    far = np.hypot(*np.moveaxis(p[:, None] - s[None, :, :2] - w[..., None] * d[None], 2, 0)).min(axis=1)
    near = points_inside(p[:, 0], p[:, 1], cross) | (far <= 0.5)
    sure = np.abs(far - 0.5) > 0.003
    assert (points_inside(p[:, 0], p[:, 1], made) == near)[sure].all()
    assert area(O.buffer([[np.array([(3.0, 3.0)])]], 2, area=False)) == pytest.approx(4 * math.pi, rel=2e-3)


def test_relations():
    p = "Polygon"
    assert O.relate(square(0, 0, 2), p, square(1, 1, 2), p) == "212101212"
    assert O.relate(square(0, 0), p, square(1, 0), p) == "FF2F11212"
    assert O.relate(square(0, 0), p, square(5, 5), p) == "FF2FF1212"
    assert O.relate(square(0, 0), p, square(0, 0), p) == "2FFF1FFF2"
    assert O.relate(square(0, 0, 4), p, square(1, 1), p) == "212FF1FF2"
    line = [[np.array([(-1.0, 0.5), (2.0, 0.5)])]]
    assert O.relate(line, "LineString", square(0, 0), p) == "101FF0212"
    assert O.relate([[np.array([(0.5, 0.5)])]], "Point", square(0, 0), p) == "0FFFFF212"
    assert O.matches("212101212", "T*T***T**") and not O.matches("FF2F11212", "T********")


def test_lines():
    parts = [np.array([(0.0, 0), (1, 0)]), np.array([(2.0, 0), (1, 0)]), np.array([(2.0, 0), (2, 1)]), np.array([(9.0, 9), (8, 8)])]
    assert sorted(len(m) for m in O.merged_lines(parts)) == [2, 4]
    a, b = [[np.array([(0.0, 0), (4, 0)])]], [[np.array([(3.0, 0), (1, 0), (1, 5)])]]
    same, against = O.shared_paths(a, b)
    assert same == [] and against[0].tolist() == [[1, 0], [3, 0]]
    frame = [[np.array([(0.0, 0), (3, 0), (3, 2), (0, 2), (0, 0)])], [np.array([(1.0, -1), (1, 3)])]]
    assert sorted(area([f]) for f in O.faces(frame)) == [2, 4] and area(O.enclosed(frame)) == 6
    assert O.nearest_places(square(0, 0), True, square(3, 0), True)[:, 0].tolist() == [1, 3]
    assert O.snapped(np.array([(0.1, 0), (5, 5)]), np.array([(0.0, 0)]), 0.2).tolist() == [[0, 0], [5, 5]]
    assert O.offset_line(np.array([(0.0, 0), (10, 0)]), 2).tolist() == [[0, 2], [10, 2]]
    assert O.offset_line(np.array([(0.0, 0), (10, 0), (10, 10)]), 2).tolist() == [[0, 2], [8, 2], [8, 10]]
    outer = O.offset_line(np.array([(0.0, 0), (10, 0), (10, 10)]), -2)
    assert outer[0].tolist() == [0, -2] and outer[-1].tolist() == [12, 10] and np.hypot(*(outer[2:-2] - [10, 0]).T) == pytest.approx(2)
    assert sum(np.hypot(*np.diff(x, axis=0).T).sum() for x in O.line_inside(np.array([(-1.0, 0.5), (3, 0.5)]), square(0, 0))) == pytest.approx(1)
    assert O.minimum_clearance(square(0, 0, 3)) == 3 and O.minimum_clearance([[np.array([(0.0, 0), (4, 0), (2, 0.5)])]]) == pytest.approx(0.5)


def test_concave_hull_of_a_horseshoe():
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 10, (400, 2))
    p = p[~((p[:, 0] > 3) & (p[:, 0] < 7) & (p[:, 1] > 3))]
    tri = delaunay(p)
    tight, loose = O.concave_hull(p, tri, 0.4), O.concave_hull(p, tri, 1.0)
    assert 60 < abs(O.ring_area(tight)) < 82 < abs(O.ring_area(loose))
    assert (points_inside(p[:, 0], p[:, 1], [[tight]]) | np.isin(p[:, 0], tight[:, 0])).all()
