"""User functions on tiles of a raster, with a halo of neighbouring cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.operators.raster import Raster


def with_halo(raster: Raster, size: int, depth: int = 0) -> DataFrame:
    """Cells with the tile (``tile_row, tile_col``) of each tile that needs them: their own and those within ``depth``."""

    def tiles(axis: str, total: int):
        low = F.greatest(F.lit(0), F.floor((F.col(axis) - depth) / size))
        high = F.least(F.lit((total - 1) // size), F.floor((F.col(axis) + depth) / size))
        return F.explode(F.sequence(low.cast("int"), high.cast("int")))

    g = raster.grid
    return raster.df.withColumn("tile_row", tiles("row", g.height)).withColumn("tile_col", tiles("col", g.width))


def _dense(pdf: pd.DataFrame, height: int, width: int, size: int, depth: int) -> tuple[np.ndarray, int, int]:
    tr, tc = int(pdf.tile_row.iloc[0]), int(pdf.tile_col.iloc[0])
    r0, c0 = max(0, tr * size - depth), max(0, tc * size - depth)
    r1, c1 = min(height, (tr + 1) * size + depth), min(width, (tc + 1) * size + depth)
    data = np.full((r1 - r0, c1 - c0), np.nan)
    data[pdf.row.to_numpy() - r0, pdf.col.to_numpy() - c0] = pdf.value.astype("float64").to_numpy()
    return data, r0, c0


def map_tiles(raster: Raster, func: Callable[[np.ndarray], np.ndarray], size: int = 256, depth: int = 0) -> Raster:
    """A raster from ``func`` of each tile's array (NaN without data) with its halo; the halo is cut off again."""
    height, width = raster.grid.shape

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data, r0, c0 = _dense(pdf, height, width, size, depth)
        out = np.asarray(func(data), dtype="float64")
        tr, tc = int(pdf.tile_row.iloc[0]) * size, int(pdf.tile_col.iloc[0]) * size
        rows, cols = np.arange(tr, min(height, tr + size)), np.arange(tc, min(width, tc + size))
        core = out[np.ix_(rows - r0, cols - c0)]
        r, c = np.meshgrid(rows, cols, indexing="ij")
        flat = core.ravel()
        return pd.DataFrame({"band": int(pdf.band.iloc[0]), "row": r.ravel(), "col": c.ravel(), "value": pd.Series(flat, dtype="Float64").mask(np.isnan(flat))})

    cells = with_halo(raster.dense(), size, depth)
    return Raster(cells.groupBy("band", "tile_row", "tile_col").applyInPandas(run, "band int, row int, col int, value double"), raster.grid)


def collect_tiles(raster: Raster, func: Callable[[np.ndarray], dict], schema: str, size: int = 256, depth: int = 0) -> DataFrame:
    """One row per tile: ``band, tile_row, tile_col`` and what ``func`` returns for its array."""
    height, width = raster.grid.shape

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data, _, _ = _dense(pdf, height, width, size, depth)
        head = {"band": int(pdf.band.iloc[0]), "tile_row": int(pdf.tile_row.iloc[0]), "tile_col": int(pdf.tile_col.iloc[0])}
        return pd.DataFrame([head | func(data)])

    return with_halo(raster.dense(), size, depth).groupBy("band", "tile_row", "tile_col").applyInPandas(run, f"band int, tile_row int, tile_col int, {schema}")
