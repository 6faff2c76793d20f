from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from strataframe.functions import geometry as G
from strataframe.functions.crs import transform_xy, utm_epsg, utm_zone
from strataframe.operators import focal
from strataframe.operators.proximity import proximity
from strataframe.operators.raster import Raster
from strataframe.operators.records import latest, latest_value
from strataframe.operators.regions import components, polygonize
from strataframe.operators.stats import get_stats, stat_name
from strataframe.plans.grid import Grid, InvalidBoundsError, InvalidGridError, InvalidResolutionError, align_bounds, check_bounds, check_resolution, default_nodata, grid_from_bounds_res, grid_from_coords, match_grid, merge_bounds, tiling
from strataframe.plans.running import running_sum
from strataframe.sources.io import features_from_geojson, features_to_geojson, read_raster, write_raster

G33 = Grid(1.0, 0.0, 0.0, 0.0, -1.0, 3.0, 3, 3, nodata=-9999.0)


def values(r: Raster) -> dict:
    return {(c.row, c.col): c.value for c in r.df.collect()}


def test_from_array_nulls_and_algebra(spark):
    r = Raster.from_array(spark, [[1, 2, None], [4, float("nan"), -9999], [7, 8, 0]], G33)
    v = values(r)
    assert v[0, 2] is None and v[1, 1] is None and v[1, 2] is None
    assert values(1 / r)[2, 2] is None and values(r // -2)[2, 0] == -4.0 and values(r % -3)[2, 1] == -1.0
    assert values(~(r > 3))[0, 0] is True and values((r > 3) & (r < 5))[1, 1] is None
    with pytest.raises(InvalidGridError):
        r + Raster(r.df, G33.translate(1, 0))
    assert r.equal(r) and r.allclose(r + 1e-9) and not r.allclose(r + 1)


def test_stats_names_and_empty(spark):
    assert stat_name("90th percentile") == "p90" and stat_name("Standard deviation") == "std"
    with pytest.raises(ValueError):
        stat_name("nonsense")
    row = get_stats(spark.createDataFrame([], "value double")).first()
    assert row.mean is None and row.valid_count == 0


def test_focal_edges_and_constant(spark):
    r = Raster.from_array(spark, [[5.0] * 3] * 3, G33)
    for name in focal.FILTERS:
        assert all(math.isclose(v, 5.0) for v in values(focal.apply_filter(r, name, 3, 1.0)).values())
    hole = Raster.from_array(spark, [[1, 1, 1], [1, None, 1], [1, 1, 10]], G33)
    assert values(focal.median_filter(hole, 3))[1, 1] == 1.0 and values(focal.median_filter(hole, 3, keep_null=True))[1, 1] is None
    with pytest.raises(ValueError):
        focal.mean_filter(r, 4)


def test_proximity_without_targets(spark):
    r = Raster.from_array(spark, [[0, 0], [0, 0]], Grid(2.0, 0, 0, 0, -3.0, 0, 2, 2))
    assert set(values(proximity(r)).values()) == {None}
    one = Raster.from_array(spark, [[1, 0], [0, 0]], r.grid)
    assert values(proximity(one))[1, 1] == math.hypot(2, 3) and values(proximity(one, unit="pixel"))[1, 1] == math.sqrt(2)


def test_components_long_path_and_polygon_with_hole(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in [*range(61), 100, 101, 200]], "id long")
    assert {r.id: r.component for r in components(edges, nodes).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 200}
    ring = Raster.from_array(spark, [[1, 1, 1], [1, 2, 1], [1, 1, 1]], G33)
    out = {r.raster_value: (r.holes, r.area) for r in polygonize(ring).select("raster_value", G.count_interior_rings("geom").alias("holes"), G.area("geom").alias("area")).collect()}
    assert out == {1.0: (1, 8.0), 2.0: (0, 1.0)}


def test_grids():
    assert G33.xy2ij(*G33.ij2xy(1, 2)) == (1, 2) and G33.bounds == (0, 0, 3, 3)
    turned = Grid(2.0, 1.0, 5.0, 1.0, -2.0, 7.0, 4, 4)
    assert turned.xy2ij(*turned.ij2xy(3, 1)) == pytest.approx((3, 1))
    assert check_bounds({"left": 0, "bottom": 1, "right": 2, "top": 3}) == (0, 1, 2, 3)
    for bad in ((1, 0, 0, 1), (0, 0, float("nan"), 1), (1, 2)):
        with pytest.raises(InvalidBoundsError):
            check_bounds(bad)
    with pytest.raises(InvalidResolutionError):
        check_resolution(-1)
    assert grid_from_bounds_res((0, 0, 10, 5), (2, 1)).shape == (5, 5) and grid_from_coords(([0, 2, 4], [0, 1])).shape == (2, 3)
    assert match_grid(G33) is G33 and match_grid(G33, bounds=(0, 0, 6, 6), shape=(2, 3)).res == (2.0, 3.0)
    with pytest.raises(InvalidGridError):
        match_grid(G33, res=1, shape=(1, 1))
    assert math.isnan(merge_bounds([(0, 0, 1, 1), (2, 2, 3, 3)], how="intersection").left)
    assert align_bounds(Grid(5.0, 0, 0, 0, -5.0, 10.0, 4, 4), (1, -6, 12, 7)) == (0, -10, 15, 10)
    assert default_nodata("uint8") == 255 and tiling((10, 10), 4, 2)[-1] == (2, 10, 2, 10)
    assert G33.set_area_or_point("Point").transform == G33.transform


def test_utm_published_points(spark):
    df = spark.createDataFrame([(0.0, 0.0), (-79.0, -179.0), (79.0, 179.0), (1.0, -59.0), (1.0, 61.0)], "lat double, lon double")
    z = utm_zone(F.col("lat"), F.col("lon"))
    assert [r[0] for r in df.select(z).collect()] == ["30N", "1S", "60N", "21N", "41N"]
    assert df.select(utm_epsg(z)).first()[0] == 32630
    x, y = transform_xy(F.lit(3.0), F.lit(0.0), 4326, 32631)
    assert df.select(x, y).first() == pytest.approx((500000.0, 0.0), abs=1e-6)
    for code, lon, lat in ((32633, 13.4, 52.5), (32718, -73.0, -40.0), (3857, 10.0, -60.0), (32661, 50.0, 85.0), (32761, -120.0, -84.0)):
        e, n = transform_xy(F.lit(lon), F.lit(lat), 4326, code)
        back = transform_xy(e, n, code, 4326)
        assert df.select(*back).first() == pytest.approx((lon, lat), abs=1e-8)


def test_raster_and_feature_files(spark, tmp_path):
    r = Raster.from_array(spark, [[float(i * 10 + j) for j in range(10)] for i in range(10)], Grid(1.0, 0, 0, 0, -1.0, 10.0, 10, 10))
    write_raster(r, str(tmp_path / "r"), tile=4)
    assert read_raster(spark, str(tmp_path / "r")).equal(r)
    assert read_raster(spark, str(tmp_path / "r"), [1], (5, 9, 2, 4)).equal(r.icrop(5, 9, 2, 4))
    df = spark.range(2).select(F.col("id").alias("feature_id"), F.lit("a").alias("name"), G.box(F.lit(0), F.lit(0), F.col("id") + 1, F.lit(2)).alias("geom"))
    again = features_from_geojson(features_to_geojson(df).withColumnRenamed("feature", "value"))
    assert sorted(again.select("feature_id", G.area("geom")).collect()) == [(0, 2.0), (1, 4.0)]


def test_latest_and_running_sum(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 2), (2, "d", None), (None, "e", 9)], "k int, v string, t int").selectExpr("k", "v", "timestamp_seconds(t) AS t")
    assert sorted((r.k, r.v) for r in latest(df, ["k"], "t").collect()) == [(1, "c"), (2, "d")]
    num = df.selectExpr("k", "double(ascii(v)) AS x", "t")
    assert {r.k: r.x for r in latest_value(num, ["k"], "x", "t").collect()} == {1: 99.0, 2: 100.0, None: 101.0}
    rows = [("a" if k % 3 else None, k, 1 + k % 5) for k in range(200)]
    got = {(r.g, r.o): r.s for r in running_sum(spark.createDataFrame(rows, "g string, o int, n long"), ["g"], ["o"], "n", "s", 7).collect()}
    want, sums = {}, {}
    for g, o, n in rows:
        sums[g] = sums.get(g, 0) + n
        want[g, o] = sums[g]
    assert got == want


def test_zonal_stream(spark, tmp_path):
    from strataframe.streaming.zonal import zonal_stream

    rows = [(k, float(k % 4), 0.5, f"2024-01-0{1 + k % 3} 00:00:00", float(k)) for k in range(30)]
    schema = "point_id long, x double, y double, t timestamp, v double"
    spark.createDataFrame(rows, "point_id long, x double, y double, t string, v double").selectExpr("point_id", "x", "y", "timestamp(t) AS t", "v").write.parquet(str(tmp_path / "in"))
    zones = spark.createDataFrame([(1,), (2,)], "feature_id long").select("feature_id", G.box(F.col("feature_id") - 1.5, F.lit(0), F.col("feature_id") - 0.5, F.lit(1)).alias("geom"))
    out = zonal_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), zones, "t", "v")
    q = out.writeStream.outputMode("complete").format("memory").queryName("zones").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.feature_id, r.d): (r.n, r.total) for r in spark.sql("SELECT feature_id, day(window.start) AS d, n, total FROM zones").collect()}
    want = {}
    for k, x, _, t, v in rows:
        if x in (0.0, 1.0):
            key = (int(x) + 1, int(t[9]))
            want[key] = (want.get(key, (0, 0))[0] + 1, want.get(key, (0, 0.0))[1] + v)
    assert got == want


def test_zonal_stream_drops_what_is_late(spark, tmp_path):
    """In append mode a window comes out once, when the watermark has passed it."""
    from strataframe.streaming.zonal import zonal_stream

    schema = "point_id long, x double, y double, t timestamp, v double"
    for n, days in enumerate(((1, 1, 2), (9,), (1, 9), (20,))):
        rows = [(10 * n + k, 0.5, 0.5, f"2024-01-{d:02d} 06:00:00", 1.0) for k, d in enumerate(days)]
        spark.createDataFrame(rows, "point_id long, x double, y double, t string, v double").selectExpr("point_id", "x", "y", "timestamp(t) AS t", "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n == 0:
            zones = spark.createDataFrame([(1,)], "feature_id long").select("feature_id", G.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("geom"))
        q = zonal_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), zones, "t", "v").writeStream.outputMode("append")
        q = q.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {(r.d, r.n) for r in spark.read.parquet(str(tmp_path / "out")).selectExpr("day(window.start) AS d", "n").collect()}
    assert got == {(1, 2), (2, 1), (9, 2)}
