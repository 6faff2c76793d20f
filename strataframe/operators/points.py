"""Between rasters and points. A point table has ``point_id, x, y`` and more columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions import splines
from strataframe.operators.raster import Raster
from strataframe.operators.tiles import with_halo
from strataframe.plans.grid import Grid
from strataframe.plans.workspace import store


def ij(grid: Grid, x: str = "x", y: str = "y", shift: bool = True) -> tuple[Column, Column]:
    """Row and column, not rounded, of coordinates."""
    det = grid.a * grid.e - grid.b * grid.d
    u, v = F.col(x) - grid.c, F.col(y) - grid.f
    half = 0.5 if shift and grid.area_or_point == "Point" else 0.0
    if grid.b == 0 and grid.d == 0:
        return v / grid.e + half, u / grid.a + half
    return (grid.a * v - grid.d * u) / det + half, (grid.e * u - grid.b * v) / det + half


def xy(grid: Grid, row: str = "row", col: str = "col", dx: float = 0.0, dy: float = 0.0) -> tuple[Column, Column]:
    c, r = F.col(col) + dx, F.col(row) + dy
    return grid.a * c + grid.b * r + grid.c, grid.d * c + grid.e * r + grid.f


def outside(grid: Grid, row: Column, col: Column) -> Column:
    return (row < 0) | (col < 0) | (row >= grid.height) | (col >= grid.width)


def _located(raster: Raster, points: DataFrame) -> DataFrame:
    i, j = ij(raster.grid)
    return points.select("point_id", i.alias("i"), j.alias("j"))


#: Orders of the methods of interpolation.
ORDERS = {"nearest": 0, "linear": 1, "slinear": 1, "cubic": 3, "pchip": 3, "splinef2d": 3, "quintic": 5}
#: Sides of the tiles for splines, and cells around a tile beyond which a cell counts for less than a thousand-millionth.
TILE, HALO = 256, 28
#: Points that one task interpolates in a tile.
TILE_POINTS = 200_000


def _on_tile(method: str, steps: int, height: int, width: int):
    def run(cells: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"_n": pd.Series(dtype="int64"), "value": pd.Series(dtype="float64")})
        tr, tc = int(asked.tile_row.iloc[0]), int(asked.tile_col.iloc[0])
        r0, c0 = max(0, tr * TILE - HALO), max(0, tc * TILE - HALO)
        data = np.full((min(height, (tr + 1) * TILE + HALO) - r0, min(width, (tc + 1) * TILE + HALO) - c0), np.nan)
        data[cells.row.to_numpy() - r0, cells.col.to_numpy() - c0] = cells.value.astype("float64").to_numpy()
        i, j = asked.i.to_numpy() - r0, asked.j.to_numpy() - c0
        lost = splines.spread(np.isnan(data), steps)
        whole = splines.filled(data)
        made = splines.monotone(whole, i, j) if method == "pchip" else np.concatenate([splines.spline(whole, i[k : k + 8192], j[k : k + 8192], ORDERS[method]) for k in range(0, len(i), 8192)])
        near = lost[np.ceil(i - 0.5).astype("int64"), np.ceil(j - 0.5).astype("int64")]
        return pd.DataFrame({"_n": asked._n, "value": pd.Series(made, index=asked.index, dtype="Float64").mask(near)})

    return run


def _interp_tiles(raster: Raster, points: DataFrame, method: str, band: int, steps: int) -> DataFrame:
    """Splines tile by tile, each with a halo; the points of a crowded tile are shared out, the tile's cells sent to each share."""
    g = raster.grid
    numbered = store(points.select("point_id", "x", "y").withColumn("_n", F.monotonically_increasing_id()), "asked")
    i, j = ij(g)
    at = numbered.select("_n", i.alias("i"), j.alias("j")).where((F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("i") <= g.height - 1) & (F.col("j") <= g.width - 1))
    placed = at.withColumns({"tile_row": F.floor(F.col("i") / TILE).cast("int"), "tile_col": F.floor(F.col("j") / TILE).cast("int")})
    shares = store(placed.groupBy("tile_row", "tile_col").agg(F.ceil(F.count(F.lit(1)) / TILE_POINTS).cast("int").alias("_shares")), "shares")
    asked = placed.join(shares, ["tile_row", "tile_col"]).withColumn("_share", F.pmod(F.hash("_n"), F.col("_shares"))).drop("_shares")
    one = Raster(raster.df.where((F.col("band") == band) & F.col("value").isNotNull()), g)
    cells = with_halo(one, TILE, HALO).join(shares, ["tile_row", "tile_col"]).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).select("tile_row", "tile_col", "_share", "row", "col", "value")
    keys = ["tile_row", "tile_col", "_share"]
    made = cells.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_on_tile(method, steps, g.height, g.width), "_n bigint, value double")
    return numbered.select("_n", "point_id").join(made, "_n", "left").select("point_id", "value")


def interp(raster: Raster, points: DataFrame, method: str = "linear", band: int = 1, spread: int | str | None = None) -> DataFrame:
    """``point_id, value`` by the nearest cell, between the four around a point, or by splines; null outside and near nulls.

    Cell centres lie on whole indices. A linear value needs all four cells on the grid, and none without data within
    ``spread`` steps (along rows and columns) of the nearest cell: by default half the order rounded up (0 for 'nearest',
    1 for 'linear' and 'slinear', 2 for 'cubic', 'pchip' and 'splinef2d', 3 for 'quintic'); 'half_order_down' rounds down.
    """
    if method not in ORDERS:
        raise ValueError(f"unknown method: {method!r}")
    if spread is None or isinstance(spread, str):
        spread = ORDERS[method] // 2 if spread == "half_order_down" else -(-ORDERS[method] // 2)
    if ORDERS[method] > 1:
        return _interp_tiles(raster, points, method, band, spread)
    cells = raster.df.where((F.col("band") == band) & F.col("value").isNotNull()).select("row", "col", "value")
    g = raster.grid
    at = _located(raster, points)
    inside = (F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("i") <= g.height - 1) & (F.col("j") <= g.width - 1)
    asked = at.where(inside).withColumns({"ni": F.floor(F.col("i") + 0.5).cast("int"), "nj": F.floor(F.col("j") + 0.5).cast("int")})
    if method == "nearest":
        corners = [(F.col("ni"), F.col("nj"), F.lit(1.0))]
    else:
        i0, j0 = F.floor("i").cast("int"), F.floor("j").cast("int")
        fi, fj = F.col("i") - i0, F.col("j") - j0
        corners = [(i0, j0, (1 - fi) * (1 - fj)), (i0, j0 + 1, (1 - fi) * fj), (i0 + 1, j0, fi * (1 - fj)), (i0 + 1, j0 + 1, fi * fj)]
    near = [(F.col("ni") + a, F.col("nj") + b, F.lit(0.0)) for a in range(-spread, spread + 1) for b in range(-spread, spread + 1) if abs(a) + abs(b) <= spread]
    needs = F.explode(F.array(*[F.struct(r.alias("row"), c.alias("col"), w.cast("double").alias("w"), F.lit(k < len(corners)).alias("use")) for k, (r, c, w) in enumerate([*corners, *near])])).alias("n")
    wanted = asked.select("point_id", needs).select("point_id", "n.*").where("NOT use OR w > 0").where((F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < g.height) & (F.col("col") < g.width))
    joined = wanted.join(cells, ["row", "col"], "left")
    made = joined.groupBy("point_id").agg(F.when(F.count("value") == F.count(F.lit(1)), F.sum(F.when(F.col("use"), F.col("w") * F.col("value")))).alias("value"))
    return points.select("point_id").join(made, "point_id", "left")


def reduce_points(raster: Raster, points: DataFrame, rule: Column, window: int = 1, band: int = 1) -> DataFrame:
    """``point_id, value``: an aggregate of ``value`` over the window around the cell that holds each point.

    The window of a cell is gathered once for all points in it. Spark estimates the size of points and windows from the
    points' files and would broadcast them, so both joins are sort-merge joins.
    """
    reach = window // 2
    g = raster.grid
    i, j = ij(g)
    at = points.select("point_id", F.floor(i).cast("int").alias("r0"), F.floor(j).cast("int").alias("c0")).where(~outside(g, F.col("r0"), F.col("c0")))
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    asked = at.select("r0", "c0").distinct().select("*", F.explode(steps).alias("dr")).select("*", F.explode(steps).alias("dc"))
    cells = asked.select("r0", "c0", (F.col("r0") + F.col("dr")).alias("row"), (F.col("c0") + F.col("dc")).alias("col"))
    found = cells.join(raster.df.where(F.col("band") == band).select("row", "col", "value").hint("merge"), ["row", "col"])
    windows = found.groupBy("r0", "c0").agg(F.collect_list(F.struct("value")).alias("_cells"))  # as structs nulls stay
    joined = at.join(windows.hint("merge"), ["r0", "c0"]).select("point_id", F.explode("_cells").alias("_cell")).select("point_id", F.col("_cell.value").alias("value"))
    return points.select("point_id").join(joined.groupBy("point_id").agg(rule.alias("value")), "point_id", "left")


def to_points(raster: Raster, data_band: int = 1, names: dict[int, str] | None = None, skip_null: bool = True, offset: str = "ul") -> DataFrame:
    """``row, col, x, y`` and a column per band (b1, b2, ...); cells without data in the data band are left out."""
    cells = raster.coordinates(offset)
    bands = sorted(names) if names else [data_band]
    labels = names or {b: f"b{b}" for b in bands}
    wide = cells.where(F.col("band").isin(bands)).groupBy("row", "col", "x", "y").agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(labels[b]) for b in bands])
    return wide.where(F.col(labels[data_band]).isNotNull()) if skip_null else wide


def from_points(points: DataFrame, grid: Grid, value: str = "value") -> Raster:
    """Points on the nodes of a grid as a raster; cells without a point are null, of several points the last id counts.

    Points beside the nodes are an error when the result is computed.
    """
    i, j = ij(grid, shift=False)
    near = (F.abs(i - F.rint(i)) < 1e-6) & (F.abs(j - F.rint(j)) < 1e-6)
    node = points.select(F.when(near, F.rint(i)).otherwise(F.raise_error(F.lit("a point is not on the grid"))).cast("int").alias("row"), F.rint(j).cast("int").alias("col"), "point_id", F.col(value).alias("value"))
    last = node.where(~outside(grid, F.col("row"), F.col("col"))).groupBy("row", "col").agg(F.max_by("value", "point_id").alias("value"))
    return Raster(last.select(F.lit(1).alias("band"), "row", "col", F.col("value").cast("double").alias("value")), grid).dense()


def grid_nearest(points: DataFrame, grid: Grid, value: str = "value", reach: float = 1.0) -> Raster:
    """Each cell gets its nearest point's value (of ties the lowest id), within ``reach`` pixels along each axis."""
    i, j = ij(grid, shift=False)
    span = int(reach) + 1
    at = points.select("point_id", F.col(value).cast("double").alias("v"), i.alias("i"), j.alias("j"))
    steps = F.sequence(F.lit(-span), F.lit(span))
    sent = at.select("*", F.explode(steps).alias("dr")).select("*", F.explode(steps).alias("dc"))
    sent = sent.withColumns({"row": F.floor("i").cast("int") + F.col("dr"), "col": F.floor("j").cast("int") + F.col("dc")})
    di, dj = F.col("row") - F.col("i"), F.col("col") - F.col("j")
    close = sent.where((F.abs(di) <= reach) & (F.abs(dj) <= reach) & ~outside(grid, F.col("row"), F.col("col")))
    best = close.groupBy("row", "col").agg(F.min_by("v", F.struct(F.round(di * di + dj * dj, 9), "point_id")).alias("value"))
    return Raster(best.select(F.lit(1).alias("band"), "row", "col", "value"), grid).dense()


__all__ = ["from_points", "grid_nearest", "ij", "interp", "outside", "reduce_points", "to_points", "xy"]
