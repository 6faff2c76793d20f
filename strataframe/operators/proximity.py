"""Distance of every cell to the nearest target cell, in two passes.

The squared distance is the least over the target's rows of (rows between)**2 plus, in that row, (columns between)**2.
Pass one finds for each cell the nearest target along its row with running windows; pass two takes the least over the
cells of its column, column by column, as the lower envelope of parabolas. Both passes are linear.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from strataframe.operators.raster import Raster


def lower_envelope(at: np.ndarray, height: np.ndarray, places: np.ndarray) -> np.ndarray:
    """At each of ascending ``places``, the least of ``(place - at)**2 + height`` over all parabolas: linear time, one stack of parabolas."""
    hull, starts = [0], [-np.inf]
    f = (height + at * at).tolist()
    x = at.tolist()
    for k in range(1, len(x)):
        while True:
            j = hull[-1]
            cut = (f[k] - f[j]) / (2 * (x[k] - x[j]))
            if cut > starts[-1] or len(hull) == 1 and cut == -np.inf:
                break
            hull.pop()
            starts.pop()
        hull.append(k)
        starts.append(cut)
    own = np.array(hull)[np.searchsorted(np.array(starts), places, side="right") - 1]
    return (places - at[own]) ** 2 + height[own]


def _down(height: int, yres: float):
    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        rows = pdf.row.to_numpy()
        across = pdf.d.to_numpy(dtype="float64", na_value=np.nan)
        known = ~np.isnan(across)
        value = np.sqrt(lower_envelope(rows[known] * yres, across[known] ** 2, rows * yres)) if known.any() else np.full(len(rows), np.nan)
        return pd.DataFrame({"band": pdf.band.to_numpy(), "row": rows, "col": pdf.col.to_numpy(), "value": pd.Series(value, dtype="Float64").mask(np.isnan(value))})

    return down


def proximity(raster: Raster, targets: list[float] | None = None, unit: str = "georeferenced") -> Raster:
    """Distance to the nearest cell with one of ``targets`` (none given: any valid value but 0); null if there is none."""
    if unit not in ("georeferenced", "pixel"):
        raise ValueError(f"unit must be 'georeferenced' or 'pixel', not {unit!r}")
    xres, yres = raster.grid.res if unit == "georeferenced" else (1.0, 1.0)
    v = F.col("value").cast("double")
    hit = v.isin(targets) if targets is not None else v != 0
    cells = raster.dense().df.withColumn("t", F.when(F.coalesce(hit, F.lit(False)), F.col("col")))
    line = Window.partitionBy("band", "row").orderBy("col")
    left = F.col("col") - F.last("t", True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("t", True).over(line.rowsBetween(0, Window.unboundedFollowing)) - F.col("col")
    near = cells.select("band", "row", "col", (F.least(left, right) * xres).cast("double").alias("d"))
    return Raster(near.groupBy("band", "col").applyInPandas(_down(raster.grid.height, yres), "band int, row int, col int, value double"), raster.grid)
