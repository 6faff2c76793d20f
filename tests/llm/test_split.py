from __future__ import annotations

import itertools

import numpy as np
import pytest

from strataframe.llm.split import BALANCE, Boundaries, best_cuts, split_band, split_bands


def cost_of(size, valid, most, overlap, ends):
    mean = sum(size) / np.ceil(sum(size) / most)
    total, start = 0.0, 0
    for end in ends:
        held = sum(size[max(0, start - overlap) if start else 0 : end])
        if held > most:
            return None
        total += BALANCE * ((held - mean) / mean) ** 2
        if start:
            total += min(valid[start - 1], valid[start]) / max(1, max(valid)) + 1e-3
        start = end
    return total


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_the_best(seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 9, 9).astype(float)
    valid = np.minimum(size, rng.integers(0, 9, 9))
    for most, overlap in ((14, 1), (20, 2), (30, 0)):
        costs = [c for r in range(9) for cut in itertools.combinations(range(1, 9), r) if (c := cost_of(size, valid, most, overlap, [*cut, 9])) is not None]
        got = best_cuts(size, Boundaries.of(valid), most, overlap)
        if not costs:
            assert got is None
        elif size.sum() > most:
            assert got[0] == pytest.approx(min(costs))
            assert all(size[a:b].sum() <= most for a, b in got[1])
            assert all(b - c == overlap or c == 0 for (_, b), (c, _) in itertools.pairwise(got[1]))


def test_gap_is_preferred_and_found():
    valid = np.array([9, 9, 9, 9, 0, 9, 9, 9])
    assert Boundaries.of(valid).gaps == [(4, 5)]
    _, cuts = best_cuts(np.full(8, 10.0), Boundaries.of(valid), 50, 0)
    assert cuts in ([(0, 4), (4, 8)], [(0, 5), (5, 8)])


def test_grid_split_where_no_line_fits():
    line = np.arange(10), np.full(10, 10), np.full(10, 10)
    pieces, _ = split_band(line, line, 12, 1)
    covered = {(r, c) for _, a, b, x, y, _ in pieces for r in range(a, b) for c in range(x, y)}
    assert len(covered) == 100 and all((b - a) * (y - x) <= 12 for _, a, b, x, y, _ in pieces)


def test_bands(spark):
    rows = [("r", 1, i, j, i not in (3, 4)) for i in range(9) for j in range(5)] + [("s", 1, 0, 0, True), (None, 1, 0, 0, True), ("n", 1, 0, 0, None)]
    cells = spark.createDataFrame(rows, "raster_id string, band int, row int, col int, valid boolean").selectExpr("*", "1 AS axis")
    limits = spark.createDataFrame([("r", 30, 1), ("s", 0, None), ("n", None, 2)], "raster_id string, max_cells int, overlap_cells int")
    out = {r.raster_id: r for r in split_bands(cells, limits).collect()}
    assert set(out) == {"r", "s"} and [tuple(s) for s in out["r"].seams] == [("row", 3)]
    assert [(p.row_from, p.row_to) for p in out["r"].pieces][0][1] in (4, 5) and len(out["s"].pieces) == 1
    assert split_bands(cells.limit(0), limits).count() == 0


@pytest.mark.parametrize("valid", [[0, 0, 3, 0, 2, 0, 0, 1, 0], [1], [], [0, 0], [4, 4], [0, 5, 0, 0, 5, 5, 0], [1, 0, 1, 0, 1]])
def test_gaps_of_boundaries(valid):
    full = [k for k, v in enumerate(valid) if v]
    assert Boundaries.of(np.array(valid)).gaps == [(a + 1, b) for a, b in itertools.pairwise(full) if b - a > 1]


def test_overlap_that_does_not_fit_is_reported():
    line = np.arange(20), np.full(20, 20), np.full(20, 20)
    pieces, _ = split_band(line, line, 50, 10)
    assert {p[5] for p in pieces} == {6} and all((b - a) * (y - x) <= 50 for _, a, b, x, y, _ in pieces)
    assert {p[5] for p in split_band(line, line, 200, 3)[0]} == {3}
