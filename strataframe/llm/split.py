"""Bands of rasters that are too large, cut into overlapping pieces at natural boundaries.

A band is described by what its rows and its columns hold, so its cells are never gathered in one place. Dynamic
programming over the boundaries between lines finds the cuts of least cost: the data that a cut severs plus the imbalance
of the pieces, no piece holding more cells than allowed, consecutive pieces sharing the stated number of lines. Gaps
(runs of lines without valid cells) are the natural boundaries: cutting in one severs nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weight of a piece's squared relative deviation from the mean size against a cut through a line full of valid cells.
BALANCE = 0.25
PIECE = pa.struct([("axis", pa.string()), ("row_from", pa.int32()), ("row_to", pa.int32()), ("col_from", pa.int32()), ("col_to", pa.int32()), ("overlap", pa.int32())])
SEAM = pa.struct([("axis", pa.string()), ("seam_at", pa.int32())])
PIECE_DDL = "array<struct<axis: string, row_from: int, row_to: int, col_from: int, col_to: int, overlap: int>>"


@dataclass(frozen=True)
class Boundaries:
    """The boundaries of a profile of lines: boundary k lies before line k.

    ``penalty`` is what a cut severs: the lesser number of valid cells of the lines beside it, relative to the fullest
    line. Where it is 0 the boundary is natural. A run of them around lines without valid cells is a gap if valid cells
    stand on both sides; ``gaps`` holds the boundaries at which gaps open and those at which they close.
    """

    penalty: np.ndarray
    gaps: list[tuple[int, int]]

    @classmethod
    def of(cls, valid: np.ndarray) -> Boundaries:
        n = len(valid)
        penalty = np.zeros(n + 1)
        if n > 1:
            penalty[1:n] = np.minimum(valid[:-1], valid[1:]) / max(1, valid.max(initial=0))
        natural = np.flatnonzero(penalty[1:n] == 0) + 1
        opens = natural[(valid[natural - 1] > 0) & (valid[natural] == 0)]
        closes = natural[(valid[natural - 1] == 0) & (valid[natural] > 0)]
        closes = closes[closes > opens[0]] if len(opens) else closes[:0]
        return cls(penalty, [(int(a), int(b)) for a, b in zip(opens, closes, strict=False)])


def best_cuts(size: np.ndarray, boundaries: Boundaries, most: float, overlap: int, balance: float = BALANCE) -> tuple[float, list[tuple[int, int]]] | None:
    """Cheapest cover of lines 0..n-1 by pieces (first, end), each of at most ``most``; None where none exists.

    ``size`` holds the cells of each line. A piece begins ``overlap`` lines (fewer at the start) before the end of the one
    before it. A cut costs its boundary's penalty.
    """
    n = len(size)
    total = np.r_[0, np.cumsum(size)].astype("float64")
    if n == 0:
        return 0.0, []
    if total[-1] <= most:
        return 0.0, [(0, n)]
    mean = total[-1] / np.ceil(total[-1] / most)
    severed = boundaries.penalty + 1e-3
    severed[0] = 0.0
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    came = np.zeros(n + 1, "int64")
    for end in range(1, n + 1):
        least = int(np.searchsorted(total, total[end] - most - 1e-9, side="left"))  # first line a piece may begin with
        starts = np.arange(0 if least == 0 else min(least + overlap, end), end)
        if not len(starts):
            continue
        held = total[end] - total[np.maximum(0, starts - overlap)]
        each = cost[starts] + severed[starts] + balance * ((held - mean) / mean) ** 2
        each[held > most] = np.inf
        k = int(np.argmin(each))
        cost[end], came[end] = each[k], starts[k]
    if not np.isfinite(cost[n]):
        return None
    pieces, end = [], n
    while end:
        start = int(came[end])
        pieces.append((max(0, start - overlap), end))
        end = start
    return float(cost[n]), pieces[::-1]


def split_band(rows: tuple[np.ndarray, np.ndarray, np.ndarray], cols: tuple[np.ndarray, np.ndarray, np.ndarray], most: int, overlap: int) -> tuple[list[tuple], list[tuple[str, int]]]:
    """Pieces (axis, row_from, row_to, col_from, col_to, overlap; ends exclusive) and seams (axis, first line) of one band.

    Each of ``rows`` and ``cols`` has the lines' numbers, cells and valid cells; lines that are missing hold none. The
    axis that can be cut at the lesser cost is cut; where a single stretch of lines is too large on both axes, columns are
    cut first and each strip then by rows, sizes counted as if all cells were there. Where no piece of the allowed size can
    hold the lines that two neighbours share on both axes, they share as many as one can; ``overlap`` tells how many. Seams
    are the gaps among the boundaries that the cuts were chosen from.
    """
    low, size, bounds = {}, {}, {}
    for axis, (at, held, valid) in (("row", rows), ("col", cols)):
        low[axis], n = int(at.min()), int(at.max() - at.min()) + 1
        dense = np.zeros((2, n))
        dense[0, at - low[axis]], dense[1, at - low[axis]] = held, valid
        size[axis], bounds[axis] = dense[0], Boundaries.of(dense[1])
    found = [(axis, low[axis] + a) for axis in ("row", "col") for a, _ in bounds[axis].gaps]
    r0, r1, c0, c1 = low["row"], low["row"] + len(size["row"]), low["col"], low["col"] + len(size["col"])
    plans = [(p[0], axis, p[1]) for axis in ("row", "col") if (p := best_cuts(size[axis], bounds[axis], most, overlap)) is not None]
    if plans:
        _, axis, cuts = min(plans, key=lambda p: (p[0], p[1] != "row"))
        return [(axis, r0 + a, r0 + b, c0, c1, overlap) if axis == "row" else (axis, r0, r1, c0 + a, c0 + b, overlap) for a, b in cuts], found
    share = min(overlap, math.isqrt(most) - 1)
    wide = max(share + 1, most // (share + 1))
    _, strips = best_cuts(np.ones(c1 - c0), bounds["col"], wide, share)
    out = []
    for a, b in strips:
        _, cuts = best_cuts(np.full(r1 - r0, float(b - a)), bounds["row"], max(most, b - a), share)
        out += [("grid", r0 + x, r0 + y, c0 + a, c0 + b, share) for x, y in cuts]
    return out, found


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = batch.column(batch.schema.get_field_index("lines")).to_pylist()
        most, overlap = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("max_cells", "overlap_cells"))
        pieces, found = [], []
        for band, m, o in zip(lines, most, overlap, strict=True):
            per_axis = [tuple(np.array([line[k] for line in band if line["axis"] == axis], dtype="int64") for k in ("at", "cells", "valid")) for axis in ("row", "col")]
            p, s = split_band(*per_axis, max(1, m), max(0, o or 0))
            pieces.append([dict(zip(PIECE.names, x, strict=True)) for x in p])
            found.append([{"axis": a, "seam_at": k} for a, k in s])
        keep = [k for k, name in enumerate(batch.schema.names) if name not in ("lines", "max_cells", "overlap_cells")]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(pieces, pa.list_(PIECE)), pa.array(found, pa.list_(SEAM))], names=[*[batch.schema.names[k] for k in keep], "pieces", "seams"])


def split_bands(cells: DataFrame, limits: DataFrame, raster: Sequence[str] = ("raster_id",)) -> DataFrame:
    """One row per band that is too large: ``raster, band, pieces, seams``.

    ``cells`` has ``raster, band, row, col, valid``, each cell once; ``limits`` has ``raster, max_cells, overlap_cells``,
    one row per raster; ``raster`` names the columns that tell rasters apart. Bands with more cells than ``max_cells`` are
    split; a null or missing limit splits nothing, a null overlap counts as 0, a limit below 1 as 1. Other columns are
    ignored; rows with a null raster, band, row or column are dropped, a null ``valid`` counts as false. Empty tables give
    no rows.
    """
    keys = [*raster, "band"]
    axes = F.explode(F.array(F.struct(F.lit("row").alias("axis"), F.col("row").alias("at")), F.struct(F.lit("col").alias("axis"), F.col("col").alias("at")))).alias("line")
    known = cells.dropna(subset=[*keys, "row", "col"])
    lines = known.select(*keys, "valid", axes).groupBy(*keys, "line.axis", "line.at").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.coalesce("valid", F.lit(False))).alias("valid"))
    bands = lines.groupBy(*keys).agg(F.sum("cells").alias("twice"), F.collect_list(F.struct("axis", "at", "cells", "valid")).alias("lines"))
    large = bands.join(limits.select(*raster, "max_cells", "overlap_cells"), list(raster)).where("twice / 2 > max_cells")
    schema = T.StructType([*cells.select(*keys).schema.fields, *T._parse_datatype_string(f"pieces {PIECE_DDL}, seams array<struct<axis: string, seam_at: int>>").fields])
    return large.select(*keys, "lines", "max_cells", "overlap_cells").mapInArrow(_split, schema)
