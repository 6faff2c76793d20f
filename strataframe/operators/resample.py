"""Rasters on other grids of the same reference system, or of another one through closed-form projections.

Aggregates weigh each source cell by the share of its area that lies in a target cell. On grids whose axes are parallel
that is known from the source cell alone, which is sent to the target cells it meets; between reference systems each target
cell's outline is carried to the source, and its box there takes the place of the outline. Kernels (cubic and the like)
look up the source cells around each target cell's centre and are widened where target cells are larger.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.crs import bounds_projected, transform_xy
from strataframe.operators.points import ij, interp
from strataframe.operators.raster import Raster, merge, stack
from strataframe.plans.grid import Grid, InvalidGridError, grid_from_bounds_res, intersection, merge_bounds

#: Resampling by all source cells that share an area with a target cell, of their values and shares; those without weights count them alike.
AGGREGATES = {
    "average": lambda v, w: F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w))), "sum": lambda v, w: F.sum(v * w),
    "rms": lambda v, w: F.sqrt(F.try_divide(F.sum(v * v * w), F.sum(F.when(v.isNotNull(), w)))), "min": lambda v, w: F.min(v), "max": lambda v, w: F.max(v),
    "med": lambda v, w: F.median(v), "q1": lambda v, w: F.percentile(v, 0.25), "q3": lambda v, w: F.percentile(v, 0.75),
}
#: Overlaps below this share of a cell are rounding.
LEAST_SHARE = 1e-9


def _cubic(x: Column) -> Column:
    """Cubic convolution with a = -1/2."""
    d = F.abs(x)
    return F.when(d <= 1, (1.5 * d - 2.5) * d * d + 1).when(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2).otherwise(0.0)


def _spline(x: Column) -> Column:
    """Cubic B-spline, which smooths."""
    d = F.abs(x)
    return F.when(d <= 1, (4 - 6 * d * d + 3 * d * d * d) / 6).when(d < 2, (2 - d) * (2 - d) * (2 - d) / 6).otherwise(0.0)


def _lanczos(x: Column) -> Column:
    """Windowed sinc of three lobes."""
    t = x * math.pi
    return F.when(x == 0, 1.0).when(F.abs(x) < 3, 3 * F.sin(t) * F.sin(t / 3) / (t * t)).otherwise(0.0)


#: Kernels and how far they reach.
KERNELS = {"cubic": (_cubic, 2), "cubic_spline": (_spline, 2), "lanczos": (_lanczos, 3)}


def cell_table(raster_or_grid: Raster | Grid, df: DataFrame, offset: float = 0.5) -> DataFrame:
    """All cells of a grid with the coordinates of their centres."""
    g = raster_or_grid.grid if isinstance(raster_or_grid, Raster) else raster_or_grid
    rows = df.sparkSession.range(g.height).select(F.col("id").cast("int").alias("row"))
    cells = rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(g.width - 1))).alias("col"))
    c, r = F.col("col") + offset, F.col("row") + offset
    return cells.select("row", "col", (g.a * c + g.b * r + g.c).alias("x"), (g.d * c + g.e * r + g.f).alias("y"))


def _to(df: DataFrame, source: int | None, target: int | None) -> DataFrame:
    if source is None or target is None or source == target:
        return df
    x, y = transform_xy(F.col("x"), F.col("y"), source, target)
    return df.withColumns({"x": x, "y": y})


def _shares(low: Column, high: Column, length: int) -> Column:
    """Cells of an axis that a stretch meets, with the length they share: array of (at, share)."""
    first, last = F.greatest(F.floor(low), F.lit(0)).cast("int"), F.least(F.ceil(high) - 1, F.lit(length - 1)).cast("int")
    cells = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    share = F.transform(cells, lambda k: F.struct(k.alias("at"), (F.least(high, k + 1.0) - F.greatest(low, k.cast("double"))).alias("share")))
    return F.filter(share, lambda s: s["share"] > LEAST_SHARE)


def _parallel(source: Grid, target: Grid) -> bool:
    return (source.crs == target.crs or source.crs is None or target.crs is None) and source.b == source.d == target.b == target.d == 0


def _overlaps(raster: Raster, target: Grid) -> DataFrame:
    """``band, row, col, value, w``: source cells in the target cells they share an area with, and their share of themselves."""
    source = raster.grid
    if _parallel(source, target):
        ends = lambda k, step, origin, to_step, to_origin: [(origin + (F.col(k) + e) * step - to_origin) / to_step for e in (0, 1)]
        x0, x1 = ends("col", source.a, source.c, target.a, target.c)
        y0, y1 = ends("row", source.e, source.f, target.e, target.f)
        cells = raster.df.select("band", "value", _shares(F.least(y0, y1), F.greatest(y0, y1), target.height).alias("rs"), _shares(F.least(x0, x1), F.greatest(x0, x1), target.width).alias("cs"))
        met = cells.select("band", "value", F.explode("rs").alias("r"), "cs").select("band", "value", "r", F.explode("cs").alias("c"))
        whole = abs(source.a / target.a * source.e / target.e)
        return met.select("band", F.col("r.at").alias("row"), F.col("c.at").alias("col"), "value", (F.col("r.share") * F.col("c.share") / whole).alias("w"))
    cells = cell_table(target, raster.df).select("row", "col")
    corners = reduce(DataFrame.unionAll, [_corner(cells, source, target, dr, dc) for dr in (0, 1) for dc in (0, 1)])
    boxes = corners.groupBy("row", "col").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    cells = boxes.select("row", "col", _shares(F.col("i0"), F.col("i1"), source.height).alias("rs"), _shares(F.col("j0"), F.col("j1"), source.width).alias("cs"))
    met = cells.select("row", "col", F.explode("rs").alias("r"), "cs").select("row", "col", "r", F.explode("cs").alias("c"))
    asked = met.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("r.at").alias("row"), F.col("c.at").alias("col"), (F.col("r.share") * F.col("c.share")).alias("w"))
    return asked.join(raster.df, ["row", "col"]).select("band", F.col("to_row").alias("row"), F.col("to_col").alias("col"), "value", "w")


def _corner(cells: DataFrame, source: Grid, target: Grid, dr: int, dc: int) -> DataFrame:
    """Where a corner of each target cell lies in the source's rows and columns."""
    c, r = F.col("col") + dc, F.col("row") + dr
    at = cells.select("row", "col", (target.a * c + target.b * r + target.c).alias("x"), (target.d * c + target.e * r + target.f).alias("y"))
    i, j = ij(source, shift=False)
    return _to(at, target.crs, source.crs).select("row", "col", i.alias("i"), j.alias("j"))


def _kernel(raster: Raster, cells: DataFrame, method: str, wider: tuple[float, float]) -> DataFrame:
    """``band, row, col, value`` by a kernel around each target cell's centre; null where the nearest source cell is null."""
    rule, reach = KERNELS[method]
    source = raster.grid
    i, j = ij(source, shift=False)
    at = cells.select("row", "col", (i - 0.5).alias("i"), (j - 0.5).alias("j"))
    at = at.where((F.col("i") >= -0.5) & (F.col("j") >= -0.5) & (F.col("i") < source.height - 0.5) & (F.col("j") < source.width - 0.5))

    def around(axis: str, scale: float, length: int) -> Column:
        first, last = F.ceil(F.col(axis) - reach * scale).cast("int"), F.floor(F.col(axis) + reach * scale).cast("int")
        inside = F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(length - 1)))
        return F.transform(inside, lambda k: F.struct(k.alias("at"), rule((k - F.col(axis)) / scale).alias("w")))

    met = at.select("row", "col", F.floor(F.col("i") + 0.5).cast("int").alias("ni"), F.floor(F.col("j") + 0.5).cast("int").alias("nj"), around("i", wider[0], source.height).alias("rs"), around("j", wider[1], source.width).alias("cs"))
    met = met.select("row", "col", "ni", "nj", F.explode("rs").alias("r"), "cs").select("row", "col", "ni", "nj", "r", F.explode("cs").alias("c"))
    asked = met.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("r.at").alias("row"), F.col("c.at").alias("col"), (F.col("r.w") * F.col("c.w")).alias("w"), ((F.col("r.at") == F.col("ni")) & (F.col("c.at") == F.col("nj"))).alias("near"))
    joined = asked.join(raster.df.where("value IS NOT NULL"), ["row", "col"])
    made = joined.groupBy("band", "to_row", "to_col").agg(F.when(F.bool_or("near") & (F.sum("w") > 1e-6), F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"))
    return made.select("band", F.col("to_row").alias("row"), F.col("to_col").alias("col"), "value")


def resample(raster: Raster, target: Grid, method: str = "bilinear", bands: list[int] | None = None) -> Raster:
    """The raster on another grid.

    'nearest' and 'bilinear' look up the source at each target cell's centre, 'cubic', 'cubic_spline' and 'lanczos' weigh
    the cells around it; 'average', 'sum', 'rms', 'min', 'max', 'med', 'q1', 'q3' and 'mode' go over the source cells that
    share an area with a target cell, the weighted ones by that area. Target cells without data are null. Equal grids give
    the raster itself.
    """
    if raster.grid.same_place(target):
        return raster
    source = raster.grid
    if method in AGGREGATES:
        return Raster(_overlaps(raster, target).groupBy("band", "row", "col").agg(AGGREGATES[method](F.col("value"), F.col("w")).alias("value")), target).dense()
    if method == "mode":
        each = _overlaps(raster, target).where("value IS NOT NULL").groupBy("band", "row", "col", "value").agg(F.sum("w").alias("w"))
        return Raster(each.groupBy("band", "row", "col").agg(F.min_by("value", F.struct(F.round(-F.col("w"), 9), "value")).alias("value")), target).dense()
    if method not in ("nearest", "bilinear", *KERNELS):
        raise ValueError(f"unknown resampling: {method!r}")
    cells = _to(cell_table(target, raster.df), target.crs, source.crs)
    if method in KERNELS:
        wider = (max(1.0, abs(target.e / source.e)), max(1.0, abs(target.a / source.a))) if _parallel(source, target) else (1.0, 1.0)
        chosen = Raster(raster.df.where(F.col("band").isin(bands)), source) if bands else raster
        return Raster(_kernel(chosen, cells, method, wider), target).dense()
    points = cells.select(F.struct("row", "col").alias("point_id"), "x", "y")
    parts = []
    for band in bands or raster.bands:
        if method == "nearest":
            i, j = ij(source, shift=False)
            at = points.select("point_id", F.floor(i).cast("int").alias("row"), F.floor(j).cast("int").alias("col"))
            one = at.join(raster.df.where(F.col("band") == band).select("row", "col", "value"), ["row", "col"], "left").select("point_id", "value")
        else:
            half = points.select("point_id", (F.col("x") - source.a / 2 - source.b / 2).alias("x"), (F.col("y") - source.d / 2 - source.e / 2).alias("y"))
            plain = Grid(*source.transform, source.height, source.width)
            one = interp(Raster(raster.df, plain), half, "linear", band, spread=0)
        parts.append(one.select(F.lit(band).alias("band"), "point_id.row", "point_id.col", "value"))
    return Raster(reduce(DataFrame.unionAll, parts), target)


def estimated_grid(source: Grid, crs: int) -> Grid:
    """The grid in another reference system that holds a raster with square cells, as many along its diagonal as the source has."""
    if crs == source.crs:
        return source
    left, bottom, right, top = bounds_projected(source.bounds, source.crs, crs, min(max(source.shape), 5000))
    size = math.hypot(right - left, top - bottom) / math.hypot(*source.shape)
    made = grid_from_bounds_res((left, top - math.ceil((top - bottom) / size) * size, left + math.ceil((right - left) / size) * size, top), size, crs)
    return Grid(*made.transform, made.height, made.width, crs, source.nodata, source.area_or_point, source.dtype)


def reproject(raster: Raster, ref: Grid | Raster | None = None, crs: int | None = None, method: str = "bilinear") -> Raster:
    """On a reference's grid, or on an estimated one in another reference system."""
    if (ref is None) == (crs is None):
        raise InvalidGridError("give a reference or a reference system, and not both")
    return resample(raster, getattr(ref, "grid", ref) if ref is not None else estimated_grid(raster.grid, crs), method)


def on_one_grid(rasters: Sequence[Raster], reference: int | Grid = 0, how: str = "union", method: str = "bilinear") -> list[Raster]:
    """Rasters on one grid: the reference's cells, over the union (or intersection) of all bounds.

    Rasters that already lie on the lines of the reference's cells are only shifted, the others resampled.
    """
    base = rasters[reference].grid if isinstance(reference, int) else reference
    boxes = [r.grid.bounds if r.grid.crs in (None, base.crs) or base.crs is None else bounds_projected(r.grid.bounds, r.grid.crs, base.crs, 50) for r in rasters]
    box = merge_bounds(boxes, how=how)
    if box.left != box.left or (how == "intersection" and not reduce(lambda a, b: a and intersection(a, b), boxes[1:], boxes[0])):
        raise InvalidGridError("the rasters have no place in common")
    (i0, j0), (i1, j1) = base.xy2ij(box.left, box.top, shift=False), base.xy2ij(box.right, box.bottom, shift=False)
    r0, c0, r1, c1 = (math.floor(v + 1e-9) if k < 2 else math.ceil(v - 1e-9) for k, v in enumerate((i0, j0, i1, j1)))
    target = base.part(r0, r1, c0, c1)
    out = []
    for r in rasters:
        row, col = (target.xy2ij(r.grid.c, r.grid.f, shift=False)) if _parallel(r.grid, target) else (0.5, 0.5)
        aligned = _parallel(r.grid, target) and r.grid.a == target.a and r.grid.e == target.e and abs(row - round(row)) + abs(col - round(col)) < 1e-6
        if not aligned:
            out.append(resample(r, target, method))
            continue
        moved = r.df.select("band", (F.col("row") + round(row)).alias("row"), (F.col("col") + round(col)).alias("col"), "value")
        inside = (F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < target.height) & (F.col("col") < target.width)
        out.append(Raster(moved.where(inside), target).dense())
    return out


def stack_rasters(rasters: Sequence[Raster], reference: int | Grid = 0, diff: bool = False, method: str = "bilinear") -> Raster:
    """Rasters of any grids as bands over the union of their bounds; with ``diff``, each minus the reference."""
    made = on_one_grid(rasters, reference, "union", method)
    return stack(made, (reference if isinstance(reference, int) else 0) if diff else None)


def merge_rasters(rasters: Sequence[Raster], reducers: Sequence[str] = ("mean",), reference: int | Grid = 0, method: str = "bilinear") -> Raster:
    """Reducers over rasters of any grids, over the union of their bounds."""
    return merge(on_one_grid(rasters, reference, "union", method), reducers)


def load_multiple(rasters: Sequence[Raster], crop: bool = True, reference: int | None = None, method: str = "bilinear") -> list[Raster]:
    """Rasters cropped to what all share and, with a reference, resampled to its grid."""
    if reference is not None:
        return on_one_grid(rasters, reference, "intersection" if crop else "union", method)
    if not crop:
        return list(rasters)
    boxes = [r.grid.bounds if r.grid.crs == rasters[0].grid.crs else bounds_projected(r.grid.bounds, r.grid.crs, rasters[0].grid.crs, 50) for r in rasters]
    box = merge_bounds(boxes, how="intersection")
    if box.left != box.left:
        raise InvalidGridError("the rasters have no place in common")
    return [r.crop(box if r.grid.crs == rasters[0].grid.crs else bounds_projected(box, rasters[0].grid.crs, r.grid.crs, 50)) for r in rasters]
