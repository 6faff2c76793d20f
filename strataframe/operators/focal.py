"""Filters over windows around each cell. Nulls are left out; windows shrink at the edges; an empty one gives null."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators.raster import CELL, Raster
from strataframe.operators.tiles import map_tiles


def _check(size: int) -> int:
    if size < 1 or size % 2 == 0:
        raise ValueError("the size must be odd")
    return size // 2


def _line(axis: str, other: str, reach: int):
    """Window of neighbours along one axis; by position, so missing cells don't matter."""
    return Window.partitionBy("band", other).orderBy(axis).rangeBetween(-reach, reach)


def _separable(raster: Raster, size: int, rule: Callable[[str], Column]) -> DataFrame:
    reach = _check(size)
    rows = raster.dense().df.withColumn("value", rule("value").over(_line("col", "row", reach)))
    return rows.select(*CELL, rule("value").over(_line("row", "col", reach)).alias("value"))


def min_filter(raster: Raster, size: int = 5) -> Raster:
    return Raster(_separable(raster, size, F.min), raster.grid)


def max_filter(raster: Raster, size: int = 5) -> Raster:
    return Raster(_separable(raster, size, F.max), raster.grid)


def mean_filter(raster: Raster, size: int = 5) -> Raster:
    """Sums and counts along rows, then along columns: two passes whatever the size."""
    reach = _check(size)
    across, down = _line("col", "row", reach), _line("row", "col", reach)
    rows = raster.dense().df.select(*CELL, F.sum("value").over(across).alias("s"), F.count("value").over(across).alias("n"))
    return Raster(rows.select(*CELL, F.try_divide(F.sum("s").over(down), F.sum("n").over(down)).alias("value")), raster.grid)


def _neighbours(raster: Raster, reach: int) -> DataFrame:
    """Each valid cell sent to all cells of the grid within reach."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    sent = raster.df.where("value IS NOT NULL").select("band", "row", "col", "value", F.explode(steps).alias("dr")).select("band", (F.col("row") + F.col("dr")).alias("row"), "col", "dr", "value", F.explode(steps).alias("dc"))
    g = raster.grid
    return sent.select("band", "row", (F.col("col") + F.col("dc")).alias("col"), "value", "dr", "dc").where((F.col("row") >= 0) & (F.col("row") < g.height) & (F.col("col") >= 0) & (F.col("col") < g.width))


def window_filter(raster: Raster, size: int, rule: Column) -> Raster:
    """Any aggregate of ``value`` over the square window, each cell sent to its neighbours; :func:`generic_filter` takes numpy functions and sends tiles."""
    found = _neighbours(raster, _check(size)).groupBy(*CELL).agg(rule.alias("value"))
    return Raster(raster.dense().df.select(*CELL).join(found, CELL, "left"), raster.grid)


#: Rows and columns of the tiles that filters without a running form are computed on.
TILE = 256


def windows(data: np.ndarray, size: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows of a tile, some at a time, with the cells around each of their cells: (rows, columns, size * size), NaN beyond the tile."""
    reach = size // 2
    padded = np.pad(data, reach, constant_values=np.nan)
    view = np.lib.stride_tricks.sliding_window_view(padded, (size, size))
    step = max(1, (1 << 22) // (data.shape[1] * size * size))
    for k in range(0, data.shape[0], step):
        yield slice(k, k + step), view[k : k + step].reshape(-1, data.shape[1], size * size)


def _median(size: int):
    def run(data: np.ndarray) -> np.ndarray:
        out = np.full(data.shape, np.nan)
        for rows, around in windows(data, size):
            ordered = np.sort(around, axis=2)  # NaN comes last
            n = (~np.isnan(around)).sum(axis=2)
            low, high = (np.take_along_axis(ordered, np.maximum(0, k)[..., None], axis=2)[..., 0] for k in ((n - 1) // 2, n // 2))
            out[rows] = np.where(n > 0, (low + high) / 2, np.nan)
        return out

    return run


def median_filter(raster: Raster, size: int = 5, keep_null: bool = False) -> Raster:
    """Median of the window, on tiles with a halo; with ``keep_null``, cells without data stay so."""
    out = map_tiles(raster, _median(size), TILE, _check(size))
    if keep_null:
        was = raster.df.where("value IS NOT NULL").select(*CELL, F.lit(True).alias("_ok"))
        out = Raster(out.df.join(was, CELL, "left").select(*CELL, F.when(F.col("_ok"), F.col("value")).alias("value")), raster.grid)
    return out


def generic_filter(raster: Raster, func: Callable[[np.ndarray], np.ndarray], size: int = 3) -> Raster:
    """Any numpy function of the windows: it gets (cells, size * size), NaN without data, and gives a number per cell."""

    def run(data: np.ndarray) -> np.ndarray:
        out = np.full(data.shape, np.nan)
        for rows, around in windows(data, size):
            out[rows] = np.asarray(func(around.reshape(-1, size * size)), dtype="float64").reshape(around.shape[:2])
        return out

    return map_tiles(raster, run, TILE, _check(size))


def _gaussian(sigma: float, reach: int):
    weights = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2.0 * sigma * sigma))

    def blur(a: np.ndarray) -> np.ndarray:
        padded = np.pad(a, ((reach, reach), (0, 0)))
        return sum(w * padded[k : k + len(a)] for k, w in enumerate(weights))

    def run(data: np.ndarray) -> np.ndarray:
        valid = ~np.isnan(data)
        total, weight = (blur(blur(v).T).T for v in (np.where(valid, data, 0.0), valid.astype("float64")))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(weight > 0, total / weight, np.nan)

    return run


def gaussian_filter(raster: Raster, sigma: float = 1.0) -> Raster:
    """Mean weighted by exp(-d**2 / (2 sigma**2)) to a reach of 4 sigma, rounded; weights of nulls are left out. On tiles with a halo."""
    reach = int(4 * sigma + 0.5)
    return map_tiles(raster, _gaussian(sigma, reach), TILE, reach)


def distance_filter(raster: Raster, sigma: float = 5.0, threshold: float = 2.0) -> Raster:
    """Nulls cells that are farther than the threshold from their gaussian mean."""
    mean = gaussian_filter(raster, sigma).df.withColumnRenamed("value", "_m")
    kept = F.when(F.abs(F.col("value") - F.col("_m")) <= threshold, F.col("value"))
    return Raster(raster.df.join(mean, CELL).select(*CELL, kept.alias("value")), raster.grid)


def halo(method: str, size: int = 3, sigma: float = 1.0) -> int:
    """Cells beyond a tile that a filter needs."""
    return math.ceil(4 * sigma) if method in ("gaussian", "distance") else size // 2


FILTERS = {"mean": mean_filter, "min": min_filter, "max": max_filter, "median": median_filter, "gaussian": gaussian_filter, "distance": distance_filter}


def apply_filter(raster: Raster, method: str | Column, size: int = 3, sigma: float = 1.0, threshold: float = 2.0) -> Raster:
    """A filter by name, or an aggregate of ``value`` over the window."""
    if isinstance(method, Column):
        return window_filter(raster, size, method)
    if method not in FILTERS:
        raise ValueError(f"unknown filter: {method!r}")
    if method == "gaussian":
        return gaussian_filter(raster, sigma)
    return distance_filter(raster, sigma, threshold) if method == "distance" else FILTERS[method](raster, size)
