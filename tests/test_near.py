from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.functions.metrics import METRICS
from strataframe.functions.shapes import decode_rings, encode_rings, points_inside
from strataframe.functions.vptree import radius_pairs
from strataframe.operators.near import choose_pivots, near_pairs


def brute(x, y, r, metric):
    d = METRICS[metric](x[:, None], y[:, None], x[None, :], y[None, :])
    a, b = np.nonzero(np.triu(d <= r, 1))
    return set(zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("metric", ["plane", "great_circle"])
def test_tree_finds_all(metric):
    rng = np.random.default_rng(1)
    x, y = np.r_[rng.normal(0, 2, 400), np.zeros(120)], np.r_[rng.normal(0, 2, 400), np.zeros(120)]
    r = 0.3 if metric == "plane" else 30_000.0
    got = {(a, b) for q, d in radius_pairs(x, y, r, x, y, metric) for a, b in zip(q.tolist(), d.tolist(), strict=True) if a < b}
    assert got == brute(x, y, r, metric)


@pytest.mark.parametrize(("metric", "radius", "span"), [("plane", 0.4, 5.0), ("great_circle", 40_000.0, 4.0)])
def test_join_is_complete_with_hot_spots(spark, metric, radius, span):
    rng = np.random.default_rng(2)
    x, y = np.r_[rng.uniform(-span, span, 600), np.full(300, 0.5)], np.r_[rng.uniform(-span, span, 600), np.full(300, 0.5)]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y double")
    out = near_pairs(df, radius, metric=metric, per_cell=40).collect()
    assert len(out) == len({(r.id_a, r.id_b) for r in out})
    assert {(r.id_a, r.id_b) for r in out} == brute(x, y, radius, metric)


def test_hot_place_is_cut_into_blocks():
    pivots = choose_pivots(np.zeros(1000), np.zeros(1000), 1000, 50, 100, "plane")
    assert len(pivots.x) == 1 and pivots.blocks[0] == 5


def test_regions_with_holes_open_rings_and_blocks(spark):
    rng = np.random.default_rng(3)
    x, y = np.r_[rng.uniform(0, 10, 500), np.full(400, 2.0)], np.r_[rng.uniform(0, 10, 500), np.full(400, 2.5)]
    pts = spark.createDataFrame([(1000 + i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y double")
    ring = lambda *v: [{"x": float(a), "y": float(b)} for a, b in v]
    shapes = [(1, [[ring((1, 1), (9, 1), (9, 9), (1, 9)), ring((4, 4), (4, 6), (6, 6), (6, 4), (4, 4))]]), (2, [[ring((0, 0), (3, 0), (0, 3))], [ring((8, 8), (10, 8), (10, 10))]]), (3, []), (4, None), (5, [[]])]
    areas = spark.createDataFrame(shapes, "id long, parts array<array<array<struct<x: double, y: double>>>>")
    got = {(r.id_a, r.id_b) for r in near_pairs(pts, 0.0001, areas, per_cell=30).where(F.col("relation") == "inside").collect()}
    held1 = (x > 1) & (x < 9) & (y > 1) & (y < 9) & ~((x > 4) & (x < 6) & (y > 4) & (y < 6))
    held2 = (x + y < 3) | ((x > 8) & (y > 8) & (y - 8 < x - 8))
    assert got == {(1, 1000 + int(i)) for i in np.flatnonzero(held1)} | {(2, 1000 + int(i)) for i in np.flatnonzero(held2)}


def test_nulls_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 0.1, 0.0, "b"), (3, None, 0.0, "c"), (None, 0.0, 0.0, "d"), (4, float("nan"), 0.0, "e")], "id long, x double, y double, cell string")
    assert [(r.id_a, r.id_b) for r in near_pairs(df, 0.5).collect()] == [(1, 2)]
    assert near_pairs(df.limit(0), 0.5).count() == 0


def test_shape_bytes_round_trip():
    shape = [[np.array([[0.0, 0], [4, 0], [4, 4]]), np.array([[1.0, 0.5], [2, 0.5], [2, 1]])], [np.array([[9.0, 9], [10, 9], [10, 10]])]]
    again = decode_rings(encode_rings(shape))
    assert [[r.tolist() for r in p] for p in again] == [[r.tolist() for r in p] for p in shape]
    assert points_inside(np.array([3.0, 9.9, 1.9]), np.array([1.0, 9.1, 0.6]), again).tolist() == [True, True, False]


def test_pivots_are_refined_on_both_sides():
    rng = np.random.default_rng(8)
    x = np.r_[rng.uniform(-1000, 1000, 200), rng.normal(-900, 0.5, 4000), rng.normal(900, 0.5, 4000)]
    pivots = choose_pivots(x, rng.normal(0, 0.5, len(x)), len(x), 100, 60, "plane")
    left, right = (pivots.x < -890).sum(), (pivots.x > 890).sum()
    assert len(pivots.x) == 60 and left > 15 and right > 15
