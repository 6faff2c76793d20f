"""Grids of rasters, and how a target grid follows from references, bounds, resolutions and shapes. Driver-side only."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np

from strataframe.functions.crs import bounds_projected, footprint_projected, transform_points

#: Default nodata by data type.
DEFAULT_NODATA = {
    "bool": 255,
    "uint8": 255,
    "int8": -128,
    "uint16": 65535,
    "int16": -32768,
    "uint32": 99999,
    "int32": -99999,
    "uint64": 99999,
    "int64": -99999,
    "float16": -99999,
    "float32": -99999,
    "float64": -99999,
    "float128": -99999,
    "longdouble": -99999,
}
#: Ranges of the whole-number types.
INTEGER_RANGE = {"uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767), "uint32": (0, 4294967295), "int32": (-2147483648, 2147483647), "uint64": (0, 2**64 - 1), "int64": (-(2**63), 2**63 - 1)}
#: Where in a pixel a coordinate points to, as parts of its width and height.
OFFSETS = {"ul": (0.0, 0.0), "ur": (1.0, 0.0), "ll": (0.0, 1.0), "lr": (1.0, 1.0), "center": (0.5, 0.5)}


class InvalidGridError(ValueError):
    """A grid can't be made from the arguments."""


class InvalidBoundsError(InvalidGridError):
    """Bounds are not four finite numbers in order."""


class InvalidResolutionError(InvalidGridError):
    """A resolution is not one or two positive numbers."""


class InvalidShapeError(InvalidGridError):
    """A shape is not two positive whole numbers."""


class InvalidCoordsError(InvalidGridError):
    """Coordinates are not two regular sequences."""


class InvalidCRSError(ValueError):
    """A reference system is not known."""


class Bounds(NamedTuple):
    """Box in georeferenced units."""

    left: float
    bottom: float
    right: float
    top: float


def check_bounds(bbox: object) -> Bounds:
    """Bounds from a sequence, a mapping or anything with ``bounds`` or the four names."""
    if hasattr(bbox, "bounds") and not isinstance(bbox, (tuple, list)):
        bbox = bbox.bounds
    if isinstance(bbox, dict):
        names = ("left", "bottom", "right", "top") if "left" in bbox else ("xmin", "ymin", "xmax", "ymax") if "xmin" in bbox else ("minx", "miny", "maxx", "maxy")
        try:
            bbox = [bbox[k] for k in names]
        except KeyError as e:
            raise InvalidBoundsError(f"bounds lack {e}") from None
    elif all(hasattr(bbox, k) for k in ("left", "bottom", "right", "top")):
        bbox = [bbox.left, bbox.bottom, bbox.right, bbox.top]
    try:
        box = Bounds(*(float(v) for v in bbox))
    except (TypeError, ValueError):
        raise InvalidBoundsError(f"not bounds: {bbox!r}") from None
    if not all(map(math.isfinite, box)) or box.left > box.right or box.bottom > box.top:
        raise InvalidBoundsError(f"not finite or not in order: {box}")
    return box


def check_resolution(res: float | Sequence[float]) -> tuple[float, float]:
    """A pair of positive resolutions."""
    pair = (res, res) if isinstance(res, (int, float)) else tuple(res)
    if len(pair) != 2 or not all(isinstance(r, (int, float)) and math.isfinite(r) and r > 0 for r in pair):
        raise InvalidResolutionError(f"not a resolution: {res!r}")
    return float(pair[0]), float(pair[1])


def check_shape(shape: Sequence[int]) -> tuple[int, int]:
    """(height, width) as positive whole numbers."""
    pair = tuple(shape) if isinstance(shape, (tuple, list)) else ()
    if len(pair) != 2 or not all(float(s) == int(s) and s > 0 for s in pair):
        raise InvalidShapeError(f"not a shape: {shape!r}")
    return int(pair[0]), int(pair[1])


def check_crs(crs: object) -> int | None:
    """An EPSG code from a number or text like 'EPSG:32645'."""
    if crs is None or isinstance(crs, int) and crs > 0:
        return crs
    text = str(crs).upper().removeprefix("EPSG:").strip()
    if text.isdigit():
        return int(text)
    raise InvalidCRSError(f"not an EPSG code: {crs!r}")


def default_nodata(dtype: str) -> float:
    """The nodata that stands in exports of a type that has none set."""
    if dtype not in DEFAULT_NODATA:
        raise NotImplementedError(f"no default nodata for {dtype}")
    return DEFAULT_NODATA[dtype]


def fits(nodata: float | None, dtype: str) -> bool:
    """Whether a nodata value can be held by a type."""
    if nodata is None or dtype not in INTEGER_RANGE:
        return True
    low, high = INTEGER_RANGE[dtype]
    return math.isfinite(nodata) and float(nodata).is_integer() and low <= nodata <= high


def cast_nodata(nodata: float | None, dtype: str) -> float | None:
    """The nodata, or the type's default where it doesn't fit."""
    return nodata if fits(nodata, dtype) else default_nodata(dtype)


def common_interpretation(first: str | None, second: str | None) -> str | None:
    """Equal pixel interpretations stay, others give none."""
    return first if first == second else None


@dataclass(frozen=True)
class Grid:
    """Affine transform ``x = a*col + b*row + c, y = d*col + e*row + f``, shape and metadata of a raster."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float
    height: int
    width: int
    crs: int | None = None
    nodata: float | None = None
    area_or_point: str | None = None
    dtype: str = "float64"
    tags: dict = field(default_factory=dict, compare=False)

    @property
    def transform(self) -> tuple[float, ...]:
        return self.a, self.b, self.c, self.d, self.e, self.f

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    @property
    def res(self) -> tuple[float, float]:
        return self.a, abs(self.e)

    @property
    def bounds(self) -> Bounds:
        xs = [self.c + self.a * i + self.b * j for i in (0, self.width) for j in (0, self.height)]
        ys = [self.f + self.d * i + self.e * j for i in (0, self.width) for j in (0, self.height)]
        return Bounds(min(xs), min(ys), max(xs), max(ys))

    @property
    def footprint(self) -> list[tuple[float, float]]:
        """Closed ring of the corners, from the lower left, counter-clockwise."""
        left, bottom, right, top = self.bounds
        return [(left, bottom), (right, bottom), (right, top), (left, top), (left, bottom)]

    @property
    def profile(self) -> dict:
        """Everything but the cells."""
        return {"driver": self.tags.get("driver", "parquet"), "dtype": self.dtype, "nodata": self.nodata, "width": self.width, "height": self.height, "crs": self.crs, "transform": self.transform}

    @property
    def name(self) -> str | None:
        """Where the raster came from."""
        return self.tags.get("name")

    @property
    def driver(self) -> str | None:
        return self.tags.get("driver")

    def bounds_projected(self, crs: int, densify_points: int | None = None) -> Bounds:
        """Bounds in another reference system; by default a vertex per cell of the longer side, 5,000 at most."""
        return Bounds(*bounds_projected(self.bounds, self.crs, crs, min(max(self.shape), 5000) if densify_points is None else densify_points))

    def footprint_projected(self, crs: int, densify_points: int | None = None) -> list[tuple[float, float]]:
        """Closed ring of the dense outline in another reference system."""
        return [tuple(p) for p in footprint_projected(self.bounds, self.crs, crs, min(max(self.shape), 5000) if densify_points is None else densify_points).tolist()]

    def block_footprints(self, size: int, crs: int | None = None) -> list[list[tuple[float, float]]]:
        """The outlines of all tiles, row-major."""
        parts = [self.part(*t) for t in self.tiles(size)]
        return [p.footprint if crs is None or crs == self.crs else p.footprint_projected(crs) for p in parts]

    def same_place(self, other: Grid) -> bool:
        """Equal shape, transform and reference system."""
        return (self.shape, self.transform, self.crs) == (other.shape, other.transform, other.crs)

    def ij2xy(self, i: float, j: float, offset: str = "ul", shift: bool = True) -> tuple[float, float]:
        """Coordinate of row ``i`` and column ``j``; for a Point grid, half a pixel back if ``shift``."""
        dx, dy = OFFSETS[offset]
        half = 0.5 if shift and self.area_or_point == "Point" else 0.0
        col, row = j + dx - half, i + dy - half
        return self.a * col + self.b * row + self.c, self.d * col + self.e * row + self.f

    def xy2ij(self, x: float, y: float, shift: bool = True) -> tuple[float, float]:
        """Row and column (not rounded) of a coordinate; for a Point grid, half a pixel on if ``shift``."""
        det = self.a * self.e - self.b * self.d
        u, v = x - self.c, y - self.f
        half = 0.5 if shift and self.area_or_point == "Point" else 0.0
        return (self.a * v - self.d * u) / det + half, (self.e * u - self.b * v) / det + half

    def coords(self, offset: str = "ul") -> tuple[list[float], list[float]]:
        """x of the columns and y of the rows, both ascending, of a grid that isn't rotated."""
        xs = [self.ij2xy(0, j, offset)[0] for j in range(self.width)]
        return sorted(xs), sorted(self.ij2xy(i, 0, offset)[1] for i in range(self.height))

    def translate(self, xoff: float, yoff: float, unit: str = "georeferenced") -> Grid:
        """Moved by georeferenced units or by pixels."""
        if unit not in ("georeferenced", "pixel"):
            raise ValueError(f"unit must be 'georeferenced' or 'pixel', not {unit!r}")
        dx, dy = (xoff * self.a, yoff * self.e) if unit == "pixel" else (xoff, yoff)
        return replace(self, c=self.c + dx, f=self.f + dy)

    def set_area_or_point(self, new: str | None, shift: bool = True) -> Grid:
        """Changes the pixel interpretation; between Area and Point the grid moves by half a pixel if ``shift``."""
        if new not in (None, "Area", "Point"):
            raise ValueError(f"not a pixel interpretation: {new!r}")
        half = {("Area", "Point"): 0.5, ("Point", "Area"): -0.5}.get((self.area_or_point, new), 0.0) if shift else 0.0
        return replace(self.translate(half, half, "pixel"), area_or_point=new)

    def window(self, bbox: object) -> tuple[int, int, int, int]:
        """(row_from, row_to, col_from, col_to), ends exclusive, of bounds cut to the grid; lengths, then offsets are rounded."""
        box = intersection(self.bounds, check_bounds(bbox))
        if box is None:
            return 0, 0, 0, 0
        (i0, j0), (i1, j1) = self.xy2ij(box.left, box.top, shift=False), self.xy2ij(box.right, box.bottom, shift=False)
        row, col = min(i0, i1), min(j0, j1)
        height, width = round(abs(i1 - i0)), round(abs(j1 - j0))
        return round(row), min(self.height, round(row) + height), round(col), min(self.width, round(col) + width)

    def part(self, row_from: int, row_to: int, col_from: int, col_to: int) -> Grid:
        """The grid of a window."""
        x, y = self.a * col_from + self.b * row_from + self.c, self.d * col_from + self.e * row_from + self.f
        return replace(self, c=x, f=y, height=row_to - row_from, width=col_to - col_from)

    def tiles(self, size: int, overlap: int = 0) -> list[tuple[int, int, int, int]]:
        return tiling(self.shape, size, overlap)


def tiling(shape: tuple[int, int], size: int | tuple[int, int], overlap: int = 0) -> list[tuple[int, int, int, int]]:
    """Tiles (row_from, row_to, col_from, col_to), each with ``overlap`` more lines on every side that has any.

    A last strip that is no wider than the overlap is left to its neighbour, which reaches it anyway.
    """
    pair = (size, size) if isinstance(size, int) else size
    if any(s <= 0 for s in pair) or overlap < 0:
        raise ValueError("tile sizes must be positive and the overlap not negative")
    spans = []
    for total, step in zip(shape, pair, strict=True):
        starts = list(range(0, total, step))
        if len(starts) > 1 and total - starts[-1] <= overlap:
            starts.pop()
        spans.append([(max(0, s - overlap), min(total, s + step + overlap)) for s in starts])
    return [(*r, *c) for r in spans[0] for c in spans[1]]


def closest_rectangle(count: int) -> tuple[int, int]:
    """Rows and columns of the least rectangle of at least ``count`` fields whose sides differ by one at most."""
    side = math.isqrt(count)
    return side + (count > side * (side + 1)), side + (count > side * side)


def subdivision(shape: Sequence[int], count: int) -> tuple[tuple[int, int], int]:
    """The rectangle of blocks that cuts a shape into ``count``, and how many of its fields at the start are one block."""
    if len(shape) != 2:
        raise ValueError(f"Expected a 2D shape, got {len(shape)}D shape: {shape}")
    if count > shape[0] * shape[1]:
        raise ValueError(f"Shape '{tuple(shape)}' size ({shape[0] * shape[1]}) is smaller than 'count' ({count}).")
    rows, cols = closest_rectangle(count)
    return (rows, cols), rows * cols - count


def intersection(first: Bounds, second: Bounds) -> Bounds | None:
    """Common box, or none."""
    box = Bounds(max(first[0], second[0]), max(first[1], second[1]), min(first[2], second[2]), min(first[3], second[3]))
    return box if box.left < box.right and box.bottom < box.top else None


def merge_bounds(boxes: Iterable[object], resolution: float | None = None, how: str = "union") -> Bounds:
    """Union or intersection of boxes; with a resolution, right and top grow by the extent's remainder."""
    if how not in ("union", "intersection"):
        raise ValueError(f"how must be 'union' or 'intersection', not {how!r}")
    checked = [check_bounds(b) for b in boxes]
    inner, outer = (max, min) if how == "intersection" else (min, max)
    left, bottom = inner(b.left for b in checked), inner(b.bottom for b in checked)
    right, top = outer(b.right for b in checked), outer(b.top for b in checked)
    if left > right or bottom > top:
        return Bounds(*[math.nan] * 4)
    if resolution is not None:
        right, top = right + (right - left) % resolution, top + (top - bottom) % resolution
    return Bounds(left, bottom, right, top)


def align_bounds(grid: Grid, box: object) -> Bounds:
    """A box widened outwards to the lines of a grid: numbers of lines first, then their coordinates."""
    want = check_bounds(box)
    columns = [(x - grid.c) / grid.a for x in (want.left, want.right)]
    rows = [(y - grid.f) / grid.e for y in (want.top, want.bottom)]
    (first, last), (upper, lower) = ((math.floor(min(n)), math.ceil(max(n))) for n in (columns, rows))
    return Bounds(grid.c + first * grid.a, grid.f + lower * grid.e, grid.c + last * grid.a, grid.f + upper * grid.e)


def grid_from_bounds_res(bounds: object, res: float | Sequence[float], crs: int | None = None) -> Grid:
    """Origin at the upper left; the shape is the extent by the resolution, rounded."""
    box, (xres, yres) = check_bounds(bounds), check_resolution(res)
    height, width = round((box.top - box.bottom) / yres), round((box.right - box.left) / xres)
    if height < 1 or width < 1:
        raise InvalidGridError("the bounds are smaller than a pixel")
    return Grid(xres, 0.0, box.left, 0.0, -yres, box.top, height, width, crs)


def grid_from_bounds_shape(bounds: object, shape: Sequence[int], crs: int | None = None) -> Grid:
    box, (height, width) = check_bounds(bounds), check_shape(shape)
    return Grid((box.right - box.left) / width, 0.0, box.left, 0.0, -(box.top - box.bottom) / height, box.top, height, width, crs)


def grid_from_coords(coords: Sequence[Sequence[float]], crs: int | None = None) -> Grid:
    """Grid whose pixel corners (upper left) have the given regular x and y."""
    if len(coords) != 2 or any(len(c) < 2 for c in coords):
        raise InvalidCoordsError("coordinates are two sequences of at least two numbers")
    xs, ys = (sorted(float(v) for v in c) for c in coords)
    steps = []
    for c in (xs, ys):
        step = (c[-1] - c[0]) / (len(c) - 1)
        if step <= 0 or any(abs(v - c[0] - k * step) > 1e-6 * step for k, v in enumerate(c)):
            raise InvalidCoordsError("coordinates are not regular")
        steps.append(step)
    return Grid(steps[0], 0.0, xs[0], 0.0, -steps[1], ys[-1], len(ys), len(xs), crs)


def match_grid(source: Grid, ref: object = None, res: object = None, shape: object = None, bounds: object = None, coords: object = None, crs: object = None) -> Grid:
    """Target grid: a reference grid as it is; a reference box, or bounds, with a resolution or shape; coordinates; else
    what is missing comes from the source. A resolution excludes a shape; a reference grid excludes all others."""
    if res is not None and shape is not None:
        raise InvalidGridError("give a resolution or a shape")
    if ref is not None and bounds is not None:
        raise InvalidGridError("give a reference or bounds")
    code = check_crs(crs) if crs is not None else source.crs
    grid = ref if isinstance(ref, Grid) else getattr(ref, "grid", None)
    if grid is not None:
        if res is not None or shape is not None or coords is not None:
            raise InvalidGridError("a reference grid fixes resolution and shape")
        return replace(grid, nodata=source.nodata, dtype=source.dtype)
    if coords is not None:
        return grid_from_coords(coords, code)
    box = check_bounds(ref if ref is not None else bounds) if ref is not None or bounds is not None else source.bounds
    if shape is not None:
        made = grid_from_bounds_shape(box, shape, code)
    elif res is None and box == source.bounds and code == source.crs:
        return source
    else:
        made = grid_from_bounds_res(box, res if res is not None else source.res, code)
    return replace(made, nodata=source.nodata, dtype=source.dtype, area_or_point=source.area_or_point)


def chunk_sizes(shape: Sequence[int], size: int | Sequence[int]) -> tuple[tuple[int, ...], ...]:
    """Lengths of the chunks along each axis: whole ones, then what is left."""
    pair = (size,) * len(shape) if isinstance(size, int) else tuple(size)
    return tuple((*[s] * (n // s), *([n % s] if n % s else [])) for n, s in zip(shape, pair, strict=True))


def chunk_starts(sizes: Sequence[Sequence[int]], initial_zero: bool = True) -> tuple[tuple[int, ...], ...]:
    """Where the chunks of each axis begin (or end)."""
    ends = [tuple(itertools.accumulate(s)) for s in sizes]
    return tuple((0, *e) if initial_zero else e for e in ends)


def source_tiles(source: Grid, target: Grid, source_size: int, target_size: int, margin: int = 2) -> list[tuple[int, list[int]]]:
    """For each tile of the target, the numbers of the source tiles that its outline, wider by ``margin`` cells, meets."""
    tiles = source.tiles(source_size)
    boxes = [source.part(*t).bounds for t in tiles]
    out = []
    for k, t in enumerate(target.tiles(target_size)):
        left, bottom, right, top = target.part(*t).bounds
        wide = (left - margin * target.res[0], bottom - margin * target.res[1], right + margin * target.res[0], top + margin * target.res[1])
        box = Bounds(*bounds_projected(wide, target.crs, source.crs, 20)) if target.crs and source.crs and target.crs != source.crs else Bounds(*wide)
        out.append((k, [n for n, b in enumerate(boxes) if intersection(box, b) is not None]))
    return out


def spanned(grid: Grid, tiles: Sequence[int], size: int) -> tuple[Grid, list[tuple[int, int, int, int]]]:
    """The grid that holds some tiles of a grid, and each tile's window in it."""
    every = grid.tiles(size)
    mine = [every[t] for t in tiles]
    r0, c0 = min(m[0] for m in mine), min(m[2] for m in mine)
    whole = grid.part(r0, max(m[1] for m in mine), c0, max(m[3] for m in mine))
    return whole, [(a - r0, b - r0, c - c0, d - c0) for a, b, c, d in mine]


def reproject_nodata(source: Grid, nodata: float | None = None, dtype: str | None = None, force_source_nodata: float | None = None) -> tuple[str, float | None, float]:
    """(type, nodata of the source, nodata of the result) of a reprojection: given ones, else the source's, else the type's default."""
    kind = dtype or source.dtype
    old = force_source_nodata if force_source_nodata is not None else source.nodata
    new = nodata if nodata is not None else source.nodata if source.nodata is not None and fits(source.nodata, kind) else default_nodata(kind)
    if not fits(new, kind):
        raise ValueError(f"nodata {new} does not fit {kind}")
    return kind, old, new


def burn_dtype(fill: float, burn: object, dtype: str | None = None) -> str:
    """The type that holds both what is burnt and what is left: the given one, or the narrowest that numpy promotes to."""
    return dtype or str(np.result_type(np.min_scalar_type(fill), *[np.min_scalar_type(b) for b in (burn if isinstance(burn, (list, tuple)) else [burn])]))


def match_points(source: Grid, points: object, crs: int | None = None) -> tuple[tuple[np.ndarray, np.ndarray], bool]:
    """Coordinates in the source's reference system, and whether a single point was given.

    ``points`` is a pair of numbers or of sequences, or anything with ``x`` and ``y``; ``crs`` is theirs if it is another.
    """
    x, y = (points.x, points.y) if hasattr(points, "x") and hasattr(points, "y") else points
    single = np.ndim(x) == 0
    x, y = np.atleast_1d(np.asarray(x, dtype="float64")), np.atleast_1d(np.asarray(y, dtype="float64"))
    if x.shape != y.shape:
        raise InvalidCoordsError("x and y must be of one length")
    if crs is not None and source.crs is not None and crs != source.crs:
        x, y = transform_points(x, y, crs, source.crs)
    return (x, y), single
