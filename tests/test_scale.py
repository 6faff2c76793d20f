"""Plans for large inputs give what the plans for small ones give."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import sample, stats
from strataframe.operators.focal import TILE, gaussian_filter, generic_filter, median_filter, window_filter
from strataframe.operators.points import reduce_points
from strataframe.operators.raster import Raster
from strataframe.operators.regions import linked, polygonize
from strataframe.operators.vector import distances, sjoin_nearest, sjoin_points
from strataframe.functions import geometry as G
from strataframe.plans.boxes import meeting
from strataframe.plans.grid import Grid


def test_statistics_by_cumulative_counts(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(None if k % 11 == 0 else "ab"[k % 2], float(np.round(v, 1)) if k % 7 else None) for k, v in enumerate(rng.normal(0, 30, 3000))]
    df = spark.createDataFrame(rows, "g string, value double")
    few = stats.get_stats(df).first().asDict()
    by = {r.g: r.asDict() for r in stats.get_stats(df.where("g IS NOT NULL"), by=["g"]).collect()}
    monkeypatch.setattr(stats, "AGGREGATED", 0)
    assert stats.get_stats(df).first().asDict() == pytest.approx(few)
    for r in stats.get_stats(df.where("g IS NOT NULL"), by=["g"]).collect():
        assert {k: v for k, v in r.asDict().items() if k != "g"} == pytest.approx({k: v for k, v in by[r.g].items() if k != "g"})
    assert {r.g for r in stats.get_stats(df, names=["median", "nmad"], by=["g"]).collect()} == {"a", "b", None}
    empty = stats.get_stats(df.limit(0)).first()
    assert empty.valid_count == 0 and empty.median is None


def test_large_samples(spark, monkeypatch):
    df = spark.range(500).select(F.col("id").alias("gid"), (F.col("id") * 2).alias("v"))
    want = sorted(r.gid for r in sample.least_keys(df, 60, "gid", 5).collect())
    monkeypatch.setattr(sample, "ONE_TASK", 10)
    assert sorted(r.gid for r in sample.least_keys(df, 60, "gid", 5).collect()) == want


def test_filters_across_tiles(spark, monkeypatch):
    import strataframe.operators.focal as focal

    rng = np.random.default_rng(1)
    data = rng.normal(0, 5, (23, 31))
    data[rng.random(data.shape) < 0.2] = np.nan
    raster = Raster.from_array(spark, np.where(np.isnan(data), None, data).tolist(), Grid(1.0, 0.0, 0.0, 0.0, -1.0, 23.0, 23, 31))
    whole = [f(raster).to_array()[0] for f in (lambda r: median_filter(r, 5), lambda r: gaussian_filter(r, 1.0), lambda r: generic_filter(r, lambda w: np.nanmax(np.where(np.isnan(w), -np.inf, w), axis=1), 3))]
    assert TILE > 31
    monkeypatch.setattr(focal, "TILE", 8)
    for a, f in zip(whole, (lambda r: median_filter(r, 5), lambda r: gaussian_filter(r, 1.0), lambda r: generic_filter(r, lambda w: np.nanmax(np.where(np.isnan(w), -np.inf, w), axis=1), 3)), strict=True):
        np.testing.assert_allclose(f(raster).to_array()[0], a)
    np.testing.assert_allclose(window_filter(raster, 5, F.median("value")).to_array()[0], whole[0])


def test_linked_is_least_and_whole():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    roots = linked(300, a, b)
    assert (roots[a] == roots[b]).all() and (roots <= np.arange(300)).all() and (roots[roots] == roots).all()
    chain = linked(1000, np.arange(999), np.arange(1, 1000))
    assert (chain == 0).all()


@pytest.mark.parametrize("connectivity", [4, 8])
def test_outlines_have_the_areas_of_their_cells(spark, connectivity):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, (14, 17)).astype(float)
    raster = Raster.from_array(spark, data.tolist(), Grid(2.0, 0.0, 0.0, 0.0, -2.0, 28.0, 14, 17))
    out = polygonize(raster, connectivity=connectivity).select("component", "n_cells", "raster_value", G.area("geom").alias("area"), F.size(G.rings("geom")).alias("rings")).collect()
    assert sum(r.n_cells for r in out) == data.size
    assert all(r.area == pytest.approx(4 * r.n_cells) for r in out) if connectivity == 4 else True


def test_boxes_of_all_sizes_meet_once(spark):
    rng = np.random.default_rng(4)

    def boxes(n):
        low = rng.uniform(-50, 50, (n, 2))
        size = np.where(rng.random((n, 1)) < 0.2, 0.0, 10.0 ** rng.uniform(-3, 2, (n, 2)))
        return [(k, *map(float, (*p, *(p + s)))) for k, (p, s) in enumerate(zip(low, size, strict=True))]

    a, b = boxes(150), boxes(120)
    names = "id long, x0 double, y0 double, x1 double, y1 double"
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    got = [(r.a.id, r.b.id) for r in meeting(spark.createDataFrame([*a, (900, None, 0.0, 1.0, 1.0), (901, 5.0, 5.0, 1.0, 1.0)], names), spark.createDataFrame(b, names), box, box).collect()]
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(set(got)) and set(got) == want
    assert meeting(spark.createDataFrame(a, names), spark.createDataFrame([], names), box, box).count() == 0


def test_nearest_without_a_limit(spark):
    rng = np.random.default_rng(5)
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 100, (80, 2)))] + [(900, 5000.0, 5000.0)]
    corner = rng.uniform(0, 100, (9, 2))
    shapes = [(k, {"type": "Polygon", "parts": [[[{"x": float(x + a), "y": float(y + b)} for a, b in ((0, 0), (3, 0), (0, 2), (0, 0))]]]}) for k, (x, y) in enumerate(corner)]
    pts = spark.createDataFrame(points, "point_id long, x double, y double")
    features = spark.createDataFrame(shapes, f"feature_id long, geom {G.GEOMETRY}")
    far = pts.crossJoin(features).select("point_id", "feature_id", G.distance_to_point(F.col("geom"), F.col("x"), F.col("y")).alias("d")).toPandas()
    want = far.loc[far.groupby("point_id").d.idxmin()].set_index("point_id")
    got = sjoin_nearest(pts, features).toPandas().set_index("point_id")
    assert len(got) == 81 and (got.feature_id.sort_index() == want.feature_id.sort_index()).all() and np.allclose(got.distance.sort_index(), want.d.sort_index())
    near = sjoin_nearest(pts, features, 10.0)
    assert near.count() == (want.d <= 10).sum() and sjoin_nearest(pts, features, 10.0, "left").count() == 81
    assert sjoin_nearest(pts, features.limit(0)).count() == 0 and sjoin_points(pts, features.limit(0), "anti").count() == 81


def test_distances_in_blocks(spark):
    square = lambda x: {"type": "Polygon", "parts": [[[{"x": x + a, "y": float(b)} for a, b in ((0, 0), (2, 0), (2, 2), (0, 2))]]]}
    line = {"type": "LineString", "parts": [[[{"x": 0.0, "y": 5.0}, {"x": 4.0, "y": 5.0}]]]}
    features = spark.createDataFrame([(1, square(0.0)), (2, square(10.0)), (3, line), (4, None), (5, {"type": "Point", "parts": [[[{"x": 1.0, "y": 9.0}]]]})], f"feature_id long, geom {G.GEOMETRY}")
    points = spark.createDataFrame([(7, 1.0, 1.0), (8, 6.0, 5.0), (9, None, 1.0)], "point_id long, x double, y double")
    want = {(7, 1): 0.0, (7, 2): 9.0, (7, 3): 4.0, (7, 5): 8.0, (8, 1): 5.0, (8, 2): 5.0, (8, 3): 2.0, (8, 5): 41**0.5}
    for block in (1, 2, 1000):
        got = {(r.point_id, r.feature_id): r.distance for r in distances(points, features, block).collect()}
        assert got == pytest.approx(want)
    assert distances(points, features.limit(0)).count() == 0


@pytest.mark.parametrize("height", [20, 400])
def test_windows_of_points_are_not_broadcast(spark, tmp_path, height):
    rng = np.random.default_rng(6)
    data = rng.normal(0, 5, (height, 30))
    data[rng.random(data.shape) < 0.2] = np.nan
    raster = Raster.from_array(spark, np.where(np.isnan(data), None, data).tolist(), Grid(1.0, 0.0, 0.0, 0.0, -1.0, float(height), height, 30))
    places = F.array(*[F.pmod(F.hash("id", F.lit(k)), F.lit(1000 * n)) / 1000.0 - 1 for k, n in ((1, 32), (2, height + 2))])
    spark.range(20_000).withColumn("p", places).select(F.col("id").alias("point_id"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y")).write.parquet(f"{tmp_path}/points")
    points = spark.read.parquet(f"{tmp_path}/points")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")  # the windows have 180,000 cells
    try:
        got = reduce_points(raster, points, F.struct(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n")), 3).select("point_id", "value.*").toPandas().set_index("point_id").sort_index()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    at = points.toPandas().set_index("point_id").sort_index()
    row, col = np.floor(height - at.y).astype(int), np.floor(at.x).astype(int)
    inside = (row >= 0) & (col >= 0) & (row < height) & (col < 30)
    wide = np.pad(np.stack([np.nan_to_num(data), np.ones_like(data)]), ((0, 0), (1, 1), (1, 1)))
    sums = sum(wide[:, a : a + height, b : b + 30] for a in range(3) for b in range(3))
    assert len(got) == 20_000 and (got.n.isna() == ~inside).all() and 0 < inside.sum() < 20_000
    np.testing.assert_allclose(got[inside].to_numpy(dtype="float64"), sums[:, row[inside], col[inside]].T, atol=1e-9)
