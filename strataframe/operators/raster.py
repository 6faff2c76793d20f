"""Rasters as pixel tables: ``band, row, col, value`` with a :class:`Grid`; a null value is no data."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.functions.values import ARITHMETIC, BINARY, COMPARISON, LOGIC, apply_unary, clean
from strataframe.operators.stats import get_stats
from strataframe.plans.grid import INTEGER_RANGE, Bounds, Grid, InvalidGridError, cast_nodata, check_crs, common_interpretation, default_nodata, grid_from_coords, intersection, subdivision

CELL = ["band", "row", "col"]


@dataclass(frozen=True)
class Raster:
    """A lazy raster. Operations give new rasters; nothing runs before an action on ``df``."""

    df: DataFrame
    grid: Grid

    @staticmethod
    def from_array(spark: SparkSession, data: Sequence, grid: Grid) -> Raster:
        """From nested lists: rows of columns, or bands of them."""
        bands = data if data and data[0] and isinstance(data[0][0], (list, tuple)) else [data]
        rows = [(b + 1, i, j, None if v is None else float(v)) for b, band in enumerate(bands) for i, line in enumerate(band) for j, v in enumerate(line)]
        return Raster(spark.createDataFrame(rows, "band int, row int, col int, value double"), grid).cleaned()

    def with_value(self, value: Column, grid: Grid | None = None) -> Raster:
        return Raster(self.df.select(*CELL, value.alias("value")), grid or self.grid)

    def cleaned(self) -> Raster:
        """Nulls non-finite values and the grid's nodata."""
        return self.with_value(clean(F.col("value"), self.grid.nodata))

    @property
    def bands(self) -> list[int]:
        return [r.band for r in self.df.select("band").distinct().orderBy("band").collect()]

    @property
    def count(self) -> int:
        return len(self.bands)

    @property
    def is_mask(self) -> bool:
        return self.df.schema["value"].dataType.typeName() == "boolean"

    def set_transform(self, transform: Sequence[float]) -> Raster:
        a, b, c, d, e, f = map(float, transform)
        return Raster(self.df, replace(self.grid, a=a, b=b, c=c, d=d, e=e, f=f))

    def set_crs(self, crs: object) -> Raster:
        return Raster(self.df, replace(self.grid, crs=check_crs(crs)))

    def split_bands(self, bands: Sequence[int] | None = None) -> list[Raster]:
        return [Raster(self.df.where(F.col("band") == b).withColumn("band", F.lit(1)), self.grid) for b in bands or self.bands]

    def dense(self) -> Raster:
        """All cells of the grid, those that are missing with null."""
        spark = self.df.sparkSession
        cells = spark.range(self.grid.height).select(F.col("id").cast("int").alias("row")).select("row", F.explode(F.sequence(F.lit(0), F.lit(self.grid.width - 1))).alias("col"))
        every = self.df.select("band").distinct().crossJoin(cells)  # a handful of bands
        return Raster(every.join(self.df, CELL, "left"), self.grid)

    # --- algebra

    def _other(self, other: Raster | float) -> tuple[DataFrame, Column, Grid]:
        if not isinstance(other, Raster):
            return self.df, F.lit(other), self.grid
        if not self.grid.same_place(other.grid):
            raise InvalidGridError("both rasters must have the same shape, transform and reference system")
        nodata = other.grid.nodata if other.grid.nodata is not None else self.grid.nodata
        grid = replace(self.grid, nodata=nodata, area_or_point=common_interpretation(self.grid.area_or_point, other.grid.area_or_point))
        return self.df.join(other.df.withColumnRenamed("value", "_b"), CELL), F.col("_b"), grid

    def _with(self, other: Raster | float, rule: Callable[[Column, Column], Column], swap: bool = False, tidy: bool = True) -> Raster:
        df, b, grid = self._other(other)
        a = F.col("value")
        value = rule(b, a) if swap else rule(a, b)
        return Raster(df.select(*CELL, (clean(value) if tidy else value).alias("value")), grid)

    def __add__(self, other): return self._with(other, ARITHMETIC["add"])  # noqa: E704
    def __radd__(self, other): return self._with(other, ARITHMETIC["add"], True)  # noqa: E704
    def __sub__(self, other): return self._with(other, ARITHMETIC["sub"])  # noqa: E704
    def __rsub__(self, other): return self._with(other, ARITHMETIC["sub"], True)  # noqa: E704
    def __mul__(self, other): return self._with(other, ARITHMETIC["mul"])  # noqa: E704
    def __rmul__(self, other): return self._with(other, ARITHMETIC["mul"], True)  # noqa: E704
    def __truediv__(self, other): return self._with(other, ARITHMETIC["div"])  # noqa: E704
    def __rtruediv__(self, other): return self._with(other, ARITHMETIC["div"], True)  # noqa: E704
    def __floordiv__(self, other): return self._with(other, ARITHMETIC["floordiv"])  # noqa: E704
    def __rfloordiv__(self, other): return self._with(other, ARITHMETIC["floordiv"], True)  # noqa: E704
    def __mod__(self, other): return self._with(other, ARITHMETIC["mod"])  # noqa: E704
    def __pow__(self, other): return self._with(other, ARITHMETIC["pow"])  # noqa: E704
    def __neg__(self): return self.with_value(-F.col("value"))  # noqa: E704
    def __invert__(self): return self.with_value(~F.col("value"))  # noqa: E704
    def __and__(self, other): return self._with(other, LOGIC["and"], tidy=False)  # noqa: E704
    def __or__(self, other): return self._with(other, LOGIC["or"], tidy=False)  # noqa: E704
    def __xor__(self, other): return self._with(other, LOGIC["xor"], tidy=False)  # noqa: E704
    __rand__, __ror__, __rxor__ = __and__, __or__, __xor__

    def compare(self, name: str, other: Raster | float) -> Raster:
        """Mask of 'eq', 'ne', 'lt', 'le', 'gt' or 'ge'; null where either side is."""
        return self._with(other, COMPARISON[name], tidy=False)

    def __lt__(self, other): return self.compare("lt", other)  # noqa: E704
    def __le__(self, other): return self.compare("le", other)  # noqa: E704
    def __gt__(self, other): return self.compare("gt", other)  # noqa: E704
    def __ge__(self, other): return self.compare("ge", other)  # noqa: E704

    def apply(self, name: str, other: Raster | float | None = None) -> Raster:
        """A named function of one value, or of two."""
        return self.with_value(apply_unary(name, F.col("value"))) if other is None else self._with(other, {**ARITHMETIC, **BINARY}[name])

    def equal(self, other: Raster) -> bool:
        """Same grid, nodata and values."""
        same = self.grid.same_place(other.grid) and self.grid.nodata == other.grid.nodata and self.grid.dtype == other.grid.dtype
        return same and self.df.exceptAll(other.df).isEmpty() and other.df.exceptAll(self.df).isEmpty()

    def allclose(self, other: Raster, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
        """Same grid, the same cells valid and values within ``atol + rtol * |other|``."""
        if not self.grid.same_place(other.grid):
            return False
        both = self.df.join(other.df.withColumnRenamed("value", "_b"), CELL, "full")
        near = F.abs(F.col("value") - F.col("_b")) <= atol + rtol * F.abs("_b")
        return both.where(~F.coalesce(near, F.col("value").isNull() & F.col("_b").isNull())).isEmpty()

    # --- masks and nodata

    def select(self, mask: Raster) -> DataFrame:
        """Valid and invalid cells where a mask holds; a mask of one band goes for all."""
        keys = ["row", "col"]
        return self.df.join(mask.df.where("value").select(*keys).distinct(), keys, "left_semi")

    def assign(self, mask: Raster, value: float | None) -> Raster:
        marked = self.df.join(mask.df.where("value").select("row", "col").distinct().withColumn("_m", F.lit(True)), ["row", "col"], "left")
        return Raster(marked.select(*CELL, F.when(F.col("_m"), F.lit(value).cast("double")).otherwise(F.col("value")).alias("value")), self.grid)

    def set_mask(self, mask: Raster) -> Raster:
        """Cells where the mask is true (or above 0) become null, besides those that are."""
        held = mask.df if mask.is_mask else mask.df.withColumn("value", F.col("value") > 0)
        return self.assign(Raster(held, mask.grid), None)

    def get_mask(self) -> Raster:
        return self.with_value(F.col("value").isNull())

    def set_nodata(self, new: float | None, update_array: bool = True, update_mask: bool = True) -> Raster:
        """Changes nodata of a raster whose ``raw`` column keeps the numbers under the nulls (absent: the old nodata).

        ``update_array``: cells that hold the old nodata get the new one and stay null; without it, or without a new
        nodata, they become valid. ``update_mask``: cells that equal the new nodata become null.
        """
        old = self.grid.nodata
        raw = F.col("raw") if "raw" in self.df.columns else F.coalesce(F.col("value"), F.lit(old).cast("double"))
        was_old = F.coalesce(raw == F.lit(old).cast("double"), F.lit(False))
        null = F.col("value").isNull()
        if old is not None and update_array and new is not None:
            raw = F.when(was_old, float(new)).otherwise(raw)
        elif old is not None:
            null = null & ~was_old
        if new is not None and update_mask:
            null = null | F.coalesce(raw == float(new), F.lit(False))
        return Raster(self.df.select(*CELL, F.when(~null, raw).alias("value"), raw.alias("raw")), replace(self.grid, nodata=new))

    def astype(self, dtype: str, convert_nodata: bool = True) -> Raster:
        """Casts values, those outside the type's range become null; nodata becomes the new type's default where it doesn't fit."""
        kinds = {"uint8": "smallint", "int8": "tinyint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double", "bool": "boolean"}
        grid = replace(self.grid, dtype=dtype, nodata=cast_nodata(self.grid.nodata, dtype) if convert_nodata else self.grid.nodata)
        low, high = INTEGER_RANGE.get(dtype, (None, None))
        value = F.col("value") if low is None else F.when((F.col("value") > low - 1.0) & (F.col("value") < high + 1.0), F.col("value"))
        return self.with_value(value.try_cast(kinds[dtype]), grid)

    def filled(self, nodata: float | None = None) -> DataFrame:
        """Cells as they are exported: nulls as nodata (the type's default where none is set)."""
        fill = nodata if nodata is not None else self.grid.nodata if self.grid.nodata is not None else default_nodata(self.grid.dtype)
        return self.df.withColumn("value", F.coalesce("value", F.lit(float(fill))))

    def valid_extent(self) -> DataFrame:
        """First and last valid row and column."""
        return self.df.where("value IS NOT NULL").agg(F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"))

    # --- windows of the grid

    def icrop(self, row_from: int, row_to: int, col_from: int, col_to: int) -> Raster:
        """Rows and columns of a window (ends exclusive), numbered anew."""
        inside = (F.col("row") >= row_from) & (F.col("row") < row_to) & (F.col("col") >= col_from) & (F.col("col") < col_to)
        moved = self.df.where(inside).select("band", (F.col("row") - row_from).alias("row"), (F.col("col") - col_from).alias("col"), "value")
        return Raster(moved, self.grid.part(row_from, row_to, col_from, col_to))

    def crop(self, bbox: object) -> Raster:
        """Cells within bounds, without resampling."""
        return self.icrop(*self.grid.window(bbox))

    def translate(self, xoff: float, yoff: float, unit: str = "georeferenced") -> Raster:
        return Raster(self.df, self.grid.translate(xoff, yoff, unit))

    def common_bounds(self, other: Raster) -> Bounds:
        return intersection(self.grid.bounds, other.grid.bounds) or Bounds(0.0, 0.0, 0.0, 0.0)

    def downsample(self, factor: int) -> Raster:
        """Every ``factor``-th cell, the shape rounded up."""
        g = self.grid
        grid = replace(g, a=g.a * factor, b=g.b * factor, d=g.d * factor, e=g.e * factor, height=-(-g.height // factor), width=-(-g.width // factor))
        kept = self.df.where((F.col("row") % factor == 0) & (F.col("col") % factor == 0))
        return Raster(kept.select("band", (F.col("row") / factor).cast("int").alias("row"), (F.col("col") / factor).cast("int").alias("col"), "value"), grid)

    def stats(self, names: Sequence[str] | None = None, inlier: Column | None = None) -> DataFrame:
        return get_stats(self.df, "value", names, ["band"], inlier)

    def coordinates(self, offset: str = "ul") -> DataFrame:
        """Cells with their x and y."""
        from strataframe.plans.grid import OFFSETS

        g, (dx, dy) = self.grid, OFFSETS[offset]
        half = 0.5 if g.area_or_point == "Point" else 0.0
        col, row = F.col("col") + (dx - half), F.col("row") + (dy - half)
        return self.df.select(*CELL, (g.a * col + g.b * row + g.c).alias("x"), (g.d * col + g.e * row + g.f).alias("y"), "value")

    def rotated_xy(self, angle: float) -> DataFrame:
        """Distances along (``xx``) and across (``yy``) a direction, from the least of each, of the cells' lower left corners."""
        turn, cells = math.radians(angle), self.coordinates("ll")
        x, y = F.col("x"), F.col("y")
        turned = cells.select(*CELL, (x * math.cos(turn) - y * math.sin(turn)).alias("xx"), (x * math.sin(turn) + y * math.cos(turn)).alias("yy"))
        least = turned.agg(F.min("xx").alias("_x"), F.min("yy").alias("_y"))
        return turned.crossJoin(F.broadcast(least)).select(*CELL, (F.col("xx") - F.col("_x")).alias("xx"), (F.col("yy") - F.col("_y")).alias("yy"))  # one row

    def info(self, stats: bool = False) -> str:
        """Text about grid and bands, with statistics if asked."""
        g = self.grid
        lines = [f"Driver:               {g.driver}", f"Opened from file:     {g.name}", f"Size:                 {g.width}, {g.height}", f"Number of bands:      {self.count}", f"Data types:           {g.dtype}"]
        lines += [f"Coordinate system:    {f'EPSG:{g.crs}' if g.crs else None}", f"Nodata value:         {g.nodata}", f"Pixel interpretation: {g.area_or_point}", f"Pixel size:           {g.res[0]}, {g.res[1]}", f"Upper left corner:    {g.bounds.left}, {g.bounds.top}", f"Lower right corner:   {g.bounds.right}, {g.bounds.bottom}"]
        if stats:
            for row in get_stats(self.df, "value", ["max", "min", "median", "mean", "std"], ["band"]).orderBy("band").collect():
                lines += [f"Band {row.band}:", *[f"  {n}: {row[n]}" for n in ("max", "min", "median", "mean", "std")]]
        return "\n".join(lines)

    def to_array(self) -> np.ndarray:
        """Bands, rows and columns on the driver, NaN where there is no data: for rasters that fit."""
        table = self.df.toArrow()
        band, row, col = (table.column(c).to_numpy() for c in CELL)
        numbers = np.unique(band)
        out = np.full((max(1, len(numbers)), *self.grid.shape), np.nan)
        out[np.searchsorted(numbers, band), row, col] = np.asarray(table.column("value").to_numpy(), dtype="float64")
        return out

    def to_xarray(self, name: str | None = None):
        """A DataArray with y and x at the cells' centres; needs xarray."""
        import xarray

        xs, ys = self.grid.coords("center")
        ys = ys[::-1] if self.grid.e < 0 else ys
        return xarray.DataArray(self.to_array(), dims=("band", "y", "x"), coords={"band": self.bands or [1], "y": ys, "x": xs}, name=name, attrs={"_FillValue": self.grid.nodata, "crs": self.grid.crs})

    @staticmethod
    def from_xarray(spark: SparkSession, data, crs: int | None = None) -> Raster:
        """From anything with ``values`` (rows and columns, or bands of them) and regular ``coords`` x and y of the centres."""
        xs, ys = (np.asarray(getattr(data.coords[c], "values", data.coords[c]), dtype="float64") for c in ("x", "y"))
        values = np.asarray(data.values, dtype="float64")
        grid = grid_from_coords((xs, ys), crs if crs is not None else data.attrs.get("crs")).translate(-0.5, -0.5, "pixel")
        values = values[..., ::-1, :] if ys[0] < ys[-1] else values
        return Raster.from_array(spark, np.where(np.isfinite(values), values, None).tolist(), replace(grid, nodata=data.attrs.get("_FillValue")))

    # --- functions along cells

    def cumsum(self) -> DataFrame:
        """Running sum of valid cells in row-major order, by rows whose totals are summed first."""
        lines = self.df.groupBy("band", "row").agg(F.sum("value").alias("_line"))
        above = Window.partitionBy("band").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)  # one row per line
        starts = lines.select("band", "row", F.coalesce(F.sum("_line").over(above), F.lit(0.0)).alias("_start"))
        inside = Window.partitionBy("band", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
        return self.df.join(starts, ["band", "row"]).select(*CELL, (F.col("_start") + F.coalesce(F.sum("value").over(inside), F.lit(0.0))).alias("value"))

    def gradient(self) -> DataFrame:
        """Differences per pixel along rows (``d_row``) and columns (``d_col``): central, one-sided at the edges."""

        def along(axis: str, other: str) -> Column:
            w = Window.partitionBy("band", other).orderBy(axis)
            left, right, me = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
            first, last = F.lag(axis).over(w).isNull(), F.lead(axis).over(w).isNull()
            return F.when(first, right - me).when(last, me - left).otherwise((right - left) / 2)

        return self.dense().df.select(*CELL, along("row", "col").alias("d_row"), along("col", "row").alias("d_col"))

    def extreme_cells(self) -> DataFrame:
        """Row-major number of the first greatest and first least cell of each band."""
        at = F.col("row") * self.grid.width + F.col("col")
        good = self.df.where("value IS NOT NULL").select("band", "value", at.alias("at"))
        return good.groupBy("band").agg(F.min_by("at", F.struct(-F.col("value"), "at")).alias("argmax"), F.min_by("at", F.struct("value", "at")).alias("argmin"))

    def unique(self) -> DataFrame:
        return self.df.where("value IS NOT NULL").groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"))


def stack(rasters: Sequence[Raster], diff: int | None = None) -> Raster:
    """Rasters of one band on the same grid as bands 1, 2, ...; with ``diff``, each minus the raster of that number."""
    first = rasters[0]
    for r in rasters[1:]:
        if not r.grid.same_place(first.grid):
            raise InvalidGridError("resample the rasters to one grid first")
    every = reduce(DataFrame.unionByName, [r.df.withColumn("band", F.lit(k + 1)) for k, r in enumerate(rasters)])
    if diff is not None:
        base = rasters[diff].df.select("row", "col", F.col("value").alias("_r"))
        every = every.join(base, ["row", "col"]).select(*CELL, (F.col("_r") - F.col("value")).alias("value"))
    return Raster(every, first.grid)


def merge(rasters: Sequence[Raster], reducers: Sequence[str] = ("mean",)) -> Raster:
    """One band per reducer (mean, median, min, max, sum, std, count, first) of the valid values of each cell."""
    rules = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_pop, "count": F.count}
    every = stack(rasters).df
    wide = every.groupBy("row", "col").agg(*[(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("band"))) if n == "first" else rules[n]("value")).alias(f"_{k}") for k, n in enumerate(reducers)])
    bands = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("band"), F.col(f"_{k}").cast("double").alias("value")) for k in range(len(reducers))])).alias("b")
    return Raster(wide.select("row", "col", bands).select("b.band", "row", "col", "b.value"), rasters[0].grid)


def subdivide(grid: Grid, count: int) -> Column:
    """Number of the block of each cell, 0 to ``count - 1``, of blocks that cut a grid into nearly equal parts."""
    (rows, cols), spare = subdivision(grid.shape, count)

    def place(axis: str, length: int, blocks: int) -> Column:
        return F.floor(F.col(axis) * ((blocks - 1) / (length - 1)) + 0.5) if length > 1 else F.lit(0)

    return F.greatest(F.lit(0), place("row", grid.height, rows) * cols + place("col", grid.width, cols) - spare).cast("int")
