"""Splines against polynomials and cutting into tiles; monotone pieces against their definition; nulls."""

from __future__ import annotations

import numpy as np
import pytest

from strataframe.functions import splines
from strataframe.operators import points
from strataframe.operators.raster import Raster
from strataframe.plans.grid import Grid


@pytest.mark.parametrize("order", [1, 3, 5])
def test_splines_give_polynomials_back(order):
    rng = np.random.default_rng(order)
    p = rng.normal(size=(order + 1, order + 1))
    surface = lambda i, j: np.polynomial.polynomial.polyval2d(i / 10, j / 10, p)
    i, j = np.mgrid[:14, :11]
    a, b = rng.uniform(0, 13, 200), rng.uniform(0, 10, 200)
    assert np.allclose(splines.spline(surface(i, j), a, b, order), surface(a, b))
    assert np.allclose(splines.spline(surface(i, j), i.ravel(), j.ravel(), order), surface(i, j).ravel())
    assert np.allclose(splines.spline(np.array([[1.0, 2.0]]), np.zeros(3), np.array([0, 0.5, 1]), order), [1, 1.5, 2])


def test_monotone_pieces():
    y = np.array([[0.0, 1, 4, 4, 2, 2, 9]])
    x = np.linspace(0, 6, 61)
    out = splines.monotone(y, np.zeros(61), x)
    assert np.allclose(out[::10], y[0]) and (np.diff(out[:21]) >= -1e-12).all() and np.allclose(out[30], 4) and np.allclose(out[20:31], 4) and np.allclose(out[40:51], 2)
    # slopes: ends by three points, within by the harmonic mean
    assert np.isclose(out[5], 0 * 0.5 + 0.125 * 0 + 1 * 0.5 - 0.125 * (2 / (1 / 1 + 1 / 3)) + 0.125 * max(0, (3 * 1 - 3) / 2))


def test_fill_and_spread():
    a = np.array([[1.0, np.nan, np.nan], [np.nan, np.nan, 5.0]])
    assert splines.filled(a).tolist() in ([[1, 1, 5], [1, 5, 5]], [[1, 1, 5], [1, 1, 5]])
    rng = np.random.default_rng(3)
    b = rng.normal(size=(20, 24))
    b[rng.random(b.shape) < 0.7] = np.nan
    r, c = np.nonzero(~np.isnan(b))
    got = splines.filled(b)
    for i, j in zip(*np.nonzero(np.isnan(b)), strict=True):
        d = (r - i) ** 2 + (c - j) ** 2
        assert got[i, j] in b[r[d == d.min()], c[d == d.min()]]
    assert splines.spread(np.eye(3, dtype=bool)[:1] > 2, 1).sum() == 0 and splines.spread(np.pad([[True]], 2), 2).sum() == 13


def test_tiles_and_crowded_tiles(spark, monkeypatch):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(90, 130)).cumsum(axis=0).cumsum(axis=1)
    data[40, 60] = np.nan
    raster = Raster.from_array(spark, np.where(np.isnan(data), None, data).tolist(), Grid(1.0, 0.0, 0.0, 0.0, -1.0, 90.0, 90, 130))
    xy = np.stack([rng.uniform(-3, 133, 300), rng.uniform(-3, 93, 300)], axis=1)
    asked = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)] + [(300, None, 1.0), (301, 60.0, 50.0)], "point_id long, x double, y double")
    whole = {m: {r.point_id: r.value for r in points.interp(raster, asked, m).collect()} for m in ("cubic", "quintic", "pchip")}
    monkeypatch.setattr(points, "TILE", 40)
    monkeypatch.setattr(points, "TILE_POINTS", 7)
    for m, want in whole.items():
        got = {r.point_id: r.value for r in points.interp(raster, asked, m).collect()}
        assert got.keys() == want.keys() and {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
        assert want[300] is None and want[301] is None
        assert all(abs(got[k] - v) < 1e-5 * (1 + abs(v)) for k, v in want.items() if v is not None)
    inside = (xy[:, 0] >= 0) & (xy[:, 0] <= 129) & (90 - xy[:, 1] >= 0) & (90 - xy[:, 1] <= 89)
    assert sum(whole["cubic"][k] is None for k in range(300)) <= (~inside).sum() + 3
    with pytest.raises(ValueError):
        points.interp(raster, asked, "unknown")
