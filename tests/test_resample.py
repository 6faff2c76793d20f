"""Area weights, kernels, reference systems and grids of several rasters."""

from __future__ import annotations

import numpy as np
import pytest

from strataframe.functions.crs import transform_points
from strataframe.operators.proximity import lower_envelope
from strataframe.operators.raster import Raster
from strataframe.operators.resample import estimated_grid, load_multiple, merge_rasters, reproject, resample, stack_rasters
from strataframe.plans.grid import Grid, InvalidGridError, subdivision, closest_rectangle


def values(raster: Raster) -> np.ndarray:
    return raster.to_array()[0]


@pytest.fixture(scope="module")
def four(spark):
    return Raster.from_array(spark, [[1, 2], [3, 4]], Grid(1.0, 0.0, 0.0, 0.0, -1.0, 2.0, 2, 2))


def test_area_weights_on_a_shifted_and_on_a_finer_grid(four):
    shifted = values(resample(four, Grid(1.0, 0.0, 0.5, 0.0, -1.0, 2.0, 2, 2), "average"))
    assert shifted.tolist() == [[1.5, 2], [3.5, 4]]
    assert values(resample(four, Grid(1.0, 0.0, 0.5, 0.0, -1.0, 2.0, 2, 2), "sum")).tolist() == [[1.5, 1], [3.5, 2]]
    fine = values(resample(four, Grid(0.5, 0.0, 0.0, 0.0, -0.5, 2.0, 4, 4), "average"))
    assert fine.tolist() == np.kron([[1, 2], [3, 4]], np.ones((2, 2))).tolist()
    assert values(resample(four, Grid(0.5, 0.0, 0.0, 0.0, -0.5, 2.0, 4, 4), "max")).tolist() == fine.tolist()
    assert values(resample(four, Grid(2.0, 0.0, 0.0, 0.0, -2.0, 2.0, 1, 1), "rms"))[0, 0] == pytest.approx(np.sqrt(7.5))
    assert values(resample(four, Grid(1.4, 0.0, 0.0, 0.0, -2.0, 2.0, 1, 1), "mode"))[0, 0] == 1.0
    turned = Grid(0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 2, 2)  # rows run along x
    assert values(resample(four, turned, "average")).tolist() == [[3, 1], [4, 2]]


def test_kernels_keep_constants_and_ramps(spark):
    rows, cols = np.mgrid[:12, :15]
    ramp = Raster.from_array(spark, (2.0 * cols + rows).tolist(), Grid(1.0, 0.0, 0.0, 0.0, -1.0, 12.0, 12, 15))
    target = Grid(0.5, 0.0, 4.1, 0.0, -0.5, 8.1, 6, 8)
    x, y = 4.1 + (np.arange(8) + 0.5) * 0.5, 8.1 - (np.arange(6) + 0.5) * 0.5
    want = 2 * (x[None, :] - 0.5) + (12 - y[:, None] - 0.5)
    for method, near in (("cubic", 1e-9), ("cubic_spline", 1e-9), ("lanczos", 0.1), ("bilinear", 1e-9)):
        assert np.abs(values(resample(ramp, target, method)) - want).max() < near
    with pytest.raises(ValueError):
        resample(ramp, target, "unknown")


def test_reference_systems_there_and_back(spark):
    rows, cols = np.mgrid[:30, :30]
    grid = Grid(100.0, 0.0, 480000.0, 0.0, -100.0, 4650000.0, 30, 30, 32631)
    plane = Raster.from_array(spark, (cols * 3.0 + rows).tolist(), grid)
    target = estimated_grid(grid, 4326)
    assert target.crs == 4326 and 25 <= target.height <= 40 and target.a == -target.e
    there = reproject(plane, crs=4326, method="bilinear")
    made = values(there)
    lon, lat = target.ij2xy(15, 15, "center")
    x, y = transform_points(lon, lat, 4326, 32631)
    i, j = grid.xy2ij(float(x), float(y))
    assert made[15, 15] == pytest.approx((j - 0.5) * 3 + i - 0.5, abs=0.01)
    for method in ("average", "cubic", "nearest"):
        back = values(reproject(there, ref=grid, method=method))
        inside = np.abs(back - (cols * 3.0 + rows))[8:22, 8:22]
        assert np.nanmax(inside) < 4.5
    with pytest.raises(InvalidGridError):
        reproject(plane)


def test_rasters_on_different_grids(spark, four):
    other = Raster.from_array(spark, [[10, 20], [30, 40]], Grid(1.0, 0.0, 1.0, 0.0, -1.0, 3.0, 2, 2))
    nan = np.nan
    both = stack_rasters([four, other]).to_array()
    assert both.shape == (2, 3, 3)
    np.testing.assert_array_equal(both[0], [[nan, nan, nan], [1, 2, nan], [3, 4, nan]])
    np.testing.assert_array_equal(both[1], [[nan, 10, 20], [nan, 30, 40], [nan, nan, nan]])
    np.testing.assert_array_equal(values(merge_rasters([four, other], ["mean"])), [[nan, 10, 20], [1, 16, 40], [3, 4, nan]])
    a, b = load_multiple([four, other])
    assert values(a).tolist() == [[2]] and values(b).tolist() == [[30]]
    c, d = load_multiple([four, other], reference=0)
    assert c.grid.same_place(d.grid) and values(d).tolist() == [[30]]
    far = Raster(four.df, four.grid.translate(100, 0))
    with pytest.raises(InvalidGridError):
        load_multiple([four, far])


def test_envelope_against_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(50):
        at = np.unique(rng.integers(0, 40, rng.integers(1, 12))).astype(float)
        height = rng.integers(0, 200, len(at)).astype(float)
        places = np.arange(40.0)
        want = ((places[:, None] - at[None, :]) ** 2 + height[None, :]).min(axis=1)
        assert np.allclose(lower_envelope(at, height, places), want)


def test_blocks():
    assert [closest_rectangle(n) for n in (3, 4, 9, 24, 55, 85620, 52011)] == [(2, 2), (2, 2), (3, 3), (5, 5), (7, 8), (293, 293), (228, 229)]
    with pytest.raises(ValueError, match=r"Expected a 2D shape, got 1D shape.*"):
        subdivision((5,), 2)
    with pytest.raises(ValueError, match=r"Shape.*smaller than.*"):
        subdivision((5, 2), 15)
