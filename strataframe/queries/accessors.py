"""Queries of conversions, metadata, comparisons and reflected operators of rasters and point clouds, and of files."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from strataframe.functions import geometry as G
from strataframe.functions import names
from strataframe.functions.crs import metric_epsg, utm_epsg, utm_zone
from strataframe.operators import resample, vector
from strataframe.operators.cloud import PointCloud
from strataframe.operators.points import interp
from strataframe.operators.raster import Raster
from strataframe.plans import grid as P
from strataframe.plans.grid import Grid
from strataframe.plans.workspace import shared_root, store
from strataframe.queries.fixtures import F2_GRID, SQL_F2, SQL_F3, SQL_F4, SQL_F5, SQL_F6, SQL_F7, f2, f3, f4, f5, f6, f7
from strataframe.queries.rasters import _BOTH, r6, r8, r11, rounded
from strataframe.sources.geotiff import read_geotiff, write_geotiff
from strataframe.sources.io import read_points, read_raster, write_csv, write_raster
from strataframe.sources.las import read_header, read_las, write_las

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str, *fixtures: str):
    def add(run):
        QUERIES[name] = run
        ORACLES[name] = (f"WITH {', '.join(fixtures)} " if fixtures else "") + sql
        return run

    return add


def scratch(spark, label: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


# --- reflected operators and logic of rasters

_REFLECTED = {
    "radd": (lambda a, b: 2.5 + b, "2.5::DOUBLE + b"), "rmul": (lambda a, b: 3.0 * b, "3.0::DOUBLE * b"), "rfloordiv": (lambda a, b: 7.0 // (b + 0.5), "floor(7.0::DOUBLE / (b + 0.5::DOUBLE))"),
    "sum_of_both": (lambda a, b: 1.0 + (a - b) * 2.0, "1.0::DOUBLE + (a - b) * 2.0::DOUBLE"),
}
for _n, (_rule, _sql) in _REFLECTED.items():
    query(f"algebra_{_n}", f"SELECT row, col, {r6(_sql)} AS value {_BOTH}", SQL_F2, SQL_F5)(lambda spark, d, rule=_rule: rounded(rule(f2(spark, d), f5(spark, d)).df.select("row", "col", "value")))
_SCALAR_LOGIC = {"rand": (lambda m: True & m, "p"), "ror": (lambda m: False | m, "p"), "rxor": (lambda m: True ^ m, "NOT p")}
for _n, (_rule, _sql) in _SCALAR_LOGIC.items():
    query(f"logical_{_n}", f"SELECT row, col, {_sql} AS value FROM (SELECT row, col, b > 0.05::DOUBLE AS p {_BOTH})", SQL_F2, SQL_F5)(lambda spark, d, rule=_rule: rule(f5(spark, d) > 0.05).df.select("row", "col", "value"))


@query("raster_equalities", "SELECT true AS same, false AS other, true AS near, false AS far, true AS place, false AS moved, true AS copied")
def raster_equalities(spark, d):
    a, b = f2(spark, d), f5(spark, d)
    row = (a.equal(f2(spark, d)), a.equal(b), a.allclose(a + 1e-9), a.allclose(a + 5.0), a.grid.same_place(b.grid), a.grid.same_place(a.grid.translate(1, 0)), replace(a).equal(a))
    return spark.createDataFrame([row], "same boolean, other boolean, near boolean, far boolean, place boolean, moved boolean, copied boolean")


@query("raster_mask_array", "SELECT row, col, value, value IS NULL AS masked, coalesce(value, 'NaN'::DOUBLE) = 'NaN'::DOUBLE AS nan FROM f5", SQL_F5)
def raster_mask_array(spark, d):
    r = f5(spark, d)
    nan = r.df.select("row", "col", F.isnan(F.coalesce("value", F.lit(float("nan")))).alias("nan"))
    return r.df.select("row", "col", "value").join(r.get_mask().df.select("row", "col", F.col("value").alias("masked")), ["row", "col"]).join(nan, ["row", "col"])


@query("raster_filled", "SELECT row, col, coalesce(value, -99999.0::DOUBLE) AS value FROM f5", SQL_F5)
def raster_filled(spark, d):
    return f5(spark, d).filled().select("row", "col", "value")


@query("raster_astype", "SELECT row, col, CASE WHEN value / 200 > -1 AND value / 200 < 256 THEN CAST(trunc(value / 200) AS SMALLINT) END AS value FROM f2", SQL_F2)
def raster_astype(spark, d):
    """Prices by 200 as bytes; those above 255 have no place in the type."""
    return (f2(spark, d) / 200.0).astype("uint8").df.select("row", "col", "value")


@query("raster_from_array", "SELECT 1 AS band, 0 AS row, 0 AS col, 1.0::DOUBLE AS value, 2 AS bands, false AS mask UNION ALL SELECT 1, 0, 1, NULL, 2, false UNION ALL SELECT 2, 0, 0, 3.0, 2, false UNION ALL SELECT 2, 0, 1, 4.0, 2, false")
def raster_from_array(spark, d):
    r = Raster.from_array(spark, [[[1, -9]], [[3, 4]]], Grid(1.0, 0.0, 0.0, 0.0, -1.0, 1.0, 1, 2, nodata=-9.0))
    return r.df.select("band", "row", "col", "value", F.lit(r.count).alias("bands"), F.lit(r.is_mask).alias("mask"))


@query("raster_metadata", """SELECT 30.0::DOUBLE AS xres, 478000.0::DOUBLE AS "left", 3108140.0::DOUBLE - 30 * 20 AS bottom, 5 AS corners, 32645 AS crs, -99999.0::DOUBLE AS nodata, 'float64' AS dtype, 20 AS height, 64 AS width, 'Point' AS area_or_point, '{"k": 1}' AS tags, 'a.tif' AS name, 'GTiff' AS driver, 10 AS profile, true AS informed""")
def raster_metadata(spark, d):
    import json

    g = Grid(30.0, 0.0, 478000.0, 0.0, -30.0, 3108140.0, 20, 64, 32645, -99999.0, "Point", tags={"k": 1, "name": "a.tif", "driver": "GTiff"})
    r = Raster.from_array(spark, [[1.0, 2.0]], g).set_crs("EPSG:32645").set_transform(g.transform)
    tags = {k: v for k, v in r.grid.tags.items() if k == "k"}
    row = (g.res[0], g.bounds.left, g.bounds.bottom, len(g.footprint), r.grid.crs, r.grid.nodata, r.grid.dtype, *r.grid.shape, r.grid.area_or_point, json.dumps(tags), r.grid.name, r.grid.driver, len(r.grid.profile) + 3, "median: 1.5" in r.info(stats=True) and "EPSG:32645" in r.info())
    return spark.createDataFrame([row], 'xres double, left double, bottom double, corners int, crs int, nodata double, dtype string, height int, width int, area_or_point string, tags string, name string, driver string, profile int, informed boolean')


@query("raster_to_array", "SELECT row, col, value FROM f5", SQL_F5)
def raster_to_array(spark, d):
    """Through an array and back."""
    r = f5(spark, d)
    array = r.to_array()
    return Raster.from_array(spark, [[None if v != v else v for v in line] for line in array[0].tolist()], r.grid).df.select("row", "col", "value")


@query("raster_intersection", """SELECT 10.0::DOUBLE AS "left", 0.0::DOUBLE AS bottom, 50.0::DOUBLE AS "right", 5.0::DOUBLE AS top""")
def raster_intersection(spark, d):
    return spark.createDataFrame([tuple(f2(spark, d).common_bounds(f5(spark, d).translate(10.0, -2.0)))], "left double, bottom double, right double, top double")


@query("raster_rotated_xy", f"SELECT row, col, {r6('(col * sqrt(0.75) - (6 - row) * 0.5::DOUBLE) + 3.0::DOUBLE')} AS xx, {r6('col * 0.5::DOUBLE + (6 - row) * sqrt(0.75)')} AS yy FROM f2", SQL_F2)
def raster_rotated_xy(spark, d):
    return rounded(f2(spark, d).rotated_xy(30.0).select("row", "col", "xx", "yy"), "xx", "yy")


# --- grids

_GRIDS = {
    "res": ("2.0, 3.0, 0.0, 9.0, 3, 5", lambda: P.grid_from_bounds_res((0, 0, 10, 9), (2.0, 3.0))), "shape": ("2.5, 3.0, 0.0, 9.0, 3, 4", lambda: P.grid_from_bounds_shape((0, 0, 10, 9), (3, 4))),
    "coords": ("2.0, 1.0, 1.0, 7.0, 3, 4", lambda: P.grid_from_coords(([1, 3, 5, 7], [5, 6, 7]))), "match_res": ("5.0, 3.5, 0.0, 7.0, 2, 10", lambda: P.match_grid(F2_GRID, res=(5.0, 3.5))),
    "match_bounds": ("1.0, 1.0, 10.0, 5.0, 4, 20", lambda: P.match_grid(F2_GRID, bounds=(10, 1, 30, 5))), "match_shape": ("10.0, 7.0, 0.0, 7.0, 1, 5", lambda: P.match_grid(F2_GRID, shape=(1, 5))),
    "match_ref": ("4.0, 4.0, 2.0, 8.0, 2, 3", lambda: P.match_grid(F2_GRID, ref=Grid(4.0, 0.0, 2.0, 0.0, -4.0, 8.0, 2, 3))), "match_coords": ("2.0, 1.0, 1.0, 7.0, 3, 4", lambda: P.match_grid(F2_GRID, coords=([1, 3, 5, 7], [5, 6, 7]))),
    "translated": ("1.0, 1.0, 3.0, 5.0, 7, 50", lambda: F2_GRID.translate(3.0, -2.0)), "part": ("1.0, 1.0, 7.0, 4.0, 2, 3", lambda: F2_GRID.part(3, 5, 7, 10)),
}


@query("grid_rules", " UNION ALL ".join(f"SELECT '{n}' AS rule, {', '.join(f'{v}::DOUBLE AS {c}' for v, c in zip(sql.split(', '), ('xres', 'yres', 'x0', 'y0', 'height', 'width'), strict=True))}" for n, (sql, _) in _GRIDS.items()))
def grid_rules(spark, d):
    rows = [(n, g.res[0], g.res[1], g.c, g.f, float(g.height), float(g.width)) for n, (_, make) in _GRIDS.items() for g in [make()]]
    return spark.createDataFrame(rows, "rule string, xres double, yres double, x0 double, y0 double, height double, width double")


_CHECKS = {
    "bounds": lambda: P.check_bounds({"xmin": 0, "ymin": 0, "xmax": 1, "ymax": 2}).top == 2.0, "bounds_order": lambda: P.check_bounds((1, 0, 0, 1)), "resolution": lambda: P.check_resolution(2) == (2.0, 2.0), "resolution_negative": lambda: P.check_resolution(-1),
    "shape": lambda: P.check_shape((2, 3)) == (2, 3), "shape_fraction": lambda: P.check_shape((2.5, 3)), "crs": lambda: P.check_crs("EPSG:4326") == 4326, "crs_unknown": lambda: P.check_crs("no system"), "coords_irregular": lambda: P.grid_from_coords(([0, 1, 5], [0, 1])),
    "points": lambda: P.match_points(F2_GRID, (3.0, 4.0))[1], "points_lengths": lambda: P.match_points(F2_GRID, ([1, 2], [3])), "chunks": lambda: P.chunk_sizes((7, 50), (3, 16)) == ((3, 3, 1), (16, 16, 16, 2)), "starts": lambda: P.chunk_starts(((3, 3, 1),)) == ((0, 3, 6, 7),),
    "blocks": lambda: len(F2_GRID.block_footprints(16)) == 4 and F2_GRID.block_footprints(16)[3][0] == (48.0, 0.0), "sources": lambda: P.source_tiles(F2_GRID, F2_GRID.translate(10.0, 0.0), 16, 25)[0] == (0, [0, 1, 2]), "spanned": lambda: P.spanned(F2_GRID, [1, 2], 16)[1] == [(0, 7, 0, 16), (0, 7, 16, 32)],
    "nodata": lambda: P.reproject_nodata(replace(F2_GRID, nodata=300.0), dtype="uint8") == ("uint8", 300.0, 255), "burn": lambda: P.burn_dtype(0, [1, 300]) == "uint16", "projected": lambda: P.Grid(1000.0, 0.0, 5e5, 0.0, -1000.0, 4.65e6, 10, 10, 32631).bounds_projected(4326).left - 3.0 < 1e-9,
}
_REFUSED = ("bounds_order", "resolution_negative", "shape_fraction", "crs_unknown", "coords_irregular", "points_lengths")


@query("grid_checks", " UNION ALL ".join(f"SELECT '{n}' AS rule, '{'refused' if n in _REFUSED else 'held'}' AS result" for n in _CHECKS))
def grid_checks(spark, d):
    def result(make) -> str:
        try:
            return "held" if make() else "not held"
        except ValueError:
            return "refused"

    return spark.createDataFrame([(n, result(make)) for n, make in _CHECKS.items()], "rule string, result string")


# --- names and zones


@query("utm_codes", "SELECT n AS point_id, CASE WHEN y >= 0 THEN 32600 ELSE 32700 END + greatest(1, least(60, ceil((x + 180) / 6)))::INT AS epsg, CASE WHEN y > 80 THEN 32661 WHEN y < -80 THEN 32761 ELSE CASE WHEN y >= 0 THEN 32600 ELSE 32700 END + greatest(1, least(60, ceil((x + 180) / 6)))::INT END AS metric FROM (SELECT point_id AS n, x / 2 - 180 AS x, y * 1.2::DOUBLE - 90 AS y FROM f3)", SQL_F3)
def utm_codes(spark, d):
    p = f3(spark, d).select("point_id", (F.col("x") / 2 - 180).alias("lon"), (F.col("y") * 1.2 - 90).alias("lat"))
    return p.select("point_id", utm_epsg(utm_zone(F.col("lat"), F.col("lon"))).alias("epsg"), metric_epsg(F.col("lat"), F.col("lon")).alias("metric"))


_TILES = {"N14W065": (14.5, -64.2), "S01E179": (-0.5, 179.9), "S90E000": (90.0, 0.0), "N00W180": (0.0, 180.0)}


@query("tile_names", " UNION ALL ".join(f"SELECT '{n}' AS name, {y}::DOUBLE AS lat" for n, (y, _) in _TILES.items()))
def tile_names(spark, d):
    t = spark.createDataFrame(list(_TILES.values()), "lat double, lon double")
    return t.select(names.tile_name(F.col("lat"), F.col("lon")).alias("name"), "lat")


_SCENES = {
    "TDM1_DEM__30_N00E104_DEM.tif": "TanDEM-X|TanDEM-X|TDM1|N00E104|-", "SETSM_WV02_20141026_ex1030010037D17F00_10300100380B4000_mosaic5_2m_v3.0_dem.tif": "WorldView|WV02|ArcticDEM/REMA/EarthDEM|-|2014-10-26 00:00:00",
    "SETSM_s2s041_WV02_20150615_10300100443C2D00_1030010043373000_seg1_2m_dem.tif": "WorldView|WV02|ArcticDEM/REMA/EarthDEM|-|2015-06-15 00:00:00", "AST_L1A_00303132015224418_final.tif": "Terra|ASTER|L1A|-|2015-03-13 22:44:18",
    "ILAKS1B_20190928_271_Gilkey-DEM.tif": "IceBridge|UAF-LS|ILAKS1B|-|2019-09-28 00:00:00", "srtm_06_01.tif": "SRTM|SRTM|SRTMv4.1|06_01|2000-02-15 00:00:00", "ASTGTM2_N00E108_dem.tif": "Terra|ASTER|ASTGTM2|N00E108|-",
    "N00E015.hgt": "SRTM|SRTM|SRTMGL1|N00E015|2000-02-15 00:00:00", "NASADEM_HGT_n00e041.hgt": "SRTM|SRTM|NASADEM-HGT|n00e041|2000-02-15 00:00:00", "/data/LM10170391976031AAA01.tif": "-|-|-|-|-",
}


@query("scene_names", " UNION ALL ".join(f"SELECT '{n}' AS name, '{v}' AS told" for n, v in _SCENES.items() if not n.startswith("/")))
def scene_names(spark, d):
    t = spark.createDataFrame([(n,) for n in _SCENES if not n.startswith("/")], "name string").select("name", names.scene(F.col("name")).alias("s"))
    return t.select("name", F.array_join(F.array(*[F.coalesce(F.col(f"s.{c}").cast("string"), F.lit("-")) for c in ("platform", "sensor", "product", "tile", "datetime")]), "|").alias("told"))


@query("decode_tags", "SELECT 'Terra' AS platform, NULL::VARCHAR AS sensor, 'N00E108' AS tile, TIMESTAMP '2019-09-28 10:00:00' AS datetime")
def decode_tags(spark, d):
    t = spark.createDataFrame([({"platform": " Terra", "sensor": "None", "product": "", "tile_name": "N00E108", "datetime": "2019-09-28 10:00:00"},)], "tags map<string, string>")
    return t.select(names.decode_tags(F.col("tags")).alias("t")).select("t.platform", "t.sensor", "t.tile", F.col("t.datetime").cast("timestamp_ntz").alias("datetime"))


# --- point clouds

_CLOUDS = {
    "radd": (lambda a, b: 5.0 + a, "5.0::DOUBLE + z"), "sub": (lambda a, b: a - b, "z - w"), "rmul": (lambda a, b: 2.0 * a, "2.0::DOUBLE * z"), "rtruediv": (lambda a, b: 8.0 / (b + 1.0), "8.0::DOUBLE / (w + 1)"), "rfloordiv": (lambda a, b: 9.0 // (b + 1.0), "floor(9.0::DOUBLE / (w + 1))"),
    "maximum": (lambda a, b: a.apply("maximum", b), "CASE WHEN z IS NOT NULL THEN greatest(z, w) END"), "exp": (lambda a, b: b.apply("exp"), "exp(w)"),
}
_WITH_W = "(SELECT *, (point_id % 5)::DOUBLE AS w FROM f3)"


def _two(spark, d):
    a = PointCloud(f3(spark, d))
    return a, a.with_data(F.pmod(F.col("point_id"), F.lit(5)).cast("double"))


for _n, (_rule, _sql) in _CLOUDS.items():
    query(f"pc_algebra_{_n}", f"SELECT point_id, {r6(_sql)} AS value FROM {_WITH_W}", SQL_F3)(lambda spark, d, rule=_rule: rounded(rule(*_two(spark, d)).df.select("point_id", F.col("z").alias("value"))))
_CLOUD_LOGIC = {
    "eq": (lambda a, b: b.compare("eq", 3.0), "w = 3"), "ne": (lambda a, b: b.compare("ne", 3.0), "w <> 3"), "lt": (lambda a, b: b < 3.0, "w < 3"), "ge": (lambda a, b: a >= b, "z >= w"),
    "or": (lambda a, b: (b < 1.0) | (b > 3.0), "w < 1 OR w > 3"), "xor": (lambda a, b: (b > 1.0) ^ (b > 3.0), "(w > 1) <> (w > 3)"), "rand": (lambda a, b: True & (b > 1.0), "w > 1"), "ror": (lambda a, b: False | (b > 1.0), "w > 1"), "rxor": (lambda a, b: True ^ (b > 1.0), "NOT (w > 1)"),
}
for _n, (_rule, _sql) in _CLOUD_LOGIC.items():
    query(f"pc_logic_{_n}", f"SELECT point_id, {_sql} AS value FROM {_WITH_W}", SQL_F3)(lambda spark, d, rule=_rule: rule(*_two(spark, d)).df.select("point_id", F.col("z").alias("value")))


@query("pc_select", f"SELECT point_id, x, y, z FROM {_WITH_W} WHERE w > 2", SQL_F3)
def pc_select(spark, d):
    a, b = _two(spark, d)
    return a.select(b > 2.0).df.select("point_id", "x", "y", "z")


@query("pc_columns", "SELECT point_id, CAST(trunc(w) AS INT) AS w, x + y AS s FROM (SELECT *, (point_id % 5)::DOUBLE AS w FROM f3)", SQL_F3)
def pc_columns(spark, d):
    """Another data column, of another type; the copy keeps its own."""
    a = PointCloud(f3(spark, d).withColumn("w", F.pmod(F.col("point_id"), F.lit(5)).cast("double"))).set_data_column("w").astype("int")
    return replace(a).df.select("point_id", F.col(a.data).alias("w"), (F.col("x") + F.col("y")).alias("s"))


@query("pc_from_xyz", "SELECT point_id, x, y, z FROM f3", SQL_F3)
def pc_from_xyz(spark, d):
    return PointCloud.from_xyz(f3(spark, d).withColumnsRenamed({"x": "e", "y": "n"}), "e", "n", "z", 32645, "point_id").df.select("point_id", "x", "y", "z")


@query("pc_metadata", 'SELECT count(*) AS n, min(x) AS "left", max(y) AS top, false AS mask, true AS same, true AS there, false AS elsewhere, \'z\' AS data, true AS has_z, false AS loaded FROM f3', SQL_F3)
def pc_metadata(spark, d):
    a = PointCloud(f3(spark, d))
    box = a.bounds
    row = (a.point_count, box.left, box.top, a.is_mask, a.equal(PointCloud(f3(spark, d))), a.coords_equal(a + 1.0), a.coords_equal(PointCloud(a.df.withColumn("x", F.col("x") + 1))), a.data, a.has_z, a.is_loaded)
    return spark.createDataFrame([row], "n bigint, left double, top double, mask boolean, same boolean, there boolean, elsewhere boolean, data string, has_z boolean, loaded boolean")


@query("pc_arrays", "SELECT point_id, x, y, z FROM f3 ORDER BY point_id", SQL_F3)
def pc_arrays(spark, d):
    """To an array and tuples and back; ids are counted from the least."""
    a = PointCloud(f3(spark, d))
    least = a.df.agg(F.min("point_id")).first()[0]
    back = PointCloud.from_array(spark, a.to_array()).df
    same = PointCloud.from_tuples(spark, a.to_tuples()).df
    return back.join(same, ["point_id", "x", "y", "z"]).select((F.col("point_id") + least).alias("point_id"), *PointCloud(back).to_xyz().columns)


@query("pc_functions", f"SELECT {r6('sum(z)')} AS sum, {r6('avg(z)')} AS mean, {r6('stddev_pop(z)')} AS std, {r6('median(z)')} AS median, {r6('max(z) - min(z)')} AS ptp, arg_min(point_id, (z, point_id)) AS argmin FROM f3", SQL_F3)
def pc_functions(spark, d):
    a = PointCloud(f3(spark, d))
    found = {n: a.reduce(n) for n in ("sum", "mean", "std", "median", "ptp", "argmin")}
    return rounded(spark.createDataFrame([tuple(found.values())], "sum double, mean double, std double, median double, ptp double, argmin bigint"), "sum", "mean", "std", "median", "ptp")


@query("pc_cumsum", "SELECT point_id, round(sum(coalesce(z, 0)) OVER (ORDER BY point_id), 3) + 0.0::DOUBLE AS value FROM f3", SQL_F3)
def pc_cumsum(spark, d):
    return rounded(PointCloud(f3(spark, d)).cumsum(), digits=3)


# --- files


@query("raster_files", "SELECT row, col, value FROM f5 WHERE row BETWEEN 2 AND 5 AND col >= 11", SQL_F5)
def raster_files(spark, d):
    """Cells as Parquet, a window read back."""
    path = scratch(spark, "raster")
    write_raster(f5(spark, d), path, 4)
    return read_raster(spark, path, [1], (2, 6, 11, 50)).df.select((F.col("row") + 2).alias("row"), (F.col("col") + 11).alias("col"), "value")


@query("raster_geotiff", "SELECT row, col, value FROM f5", SQL_F5)
def raster_geotiff(spark, d):
    store(spark.range(1), "place")  # makes the shared folder
    path = scratch(spark, "raster") + ".tif"
    write_geotiff(f5(spark, d), path, 3)
    return read_geotiff(spark, path).df.select("row", "col", "value")


@query("pc_las", "SELECT round(avg(x), 2) AS x, round(avg(y), 2) AS y, count(*) AS n, 32645 AS crs FROM f3", SQL_F3)
def pc_las(spark, d):
    store(spark.range(1), "place")
    path = scratch(spark, "cloud") + ".las"
    write_las(PointCloud(f3(spark, d).withColumn("z", F.lit(1.0)), "z", 32645), path)
    return read_las(spark, path, []).df.agg(F.round(F.avg("x"), 2).alias("x"), F.round(F.avg("y"), 2).alias("y"), F.count(F.lit(1)).alias("n")).withColumn("crs", F.lit(read_header(path).crs))


@query("pc_parquet", "SELECT point_id, x, y, z FROM f3", SQL_F3)
def pc_parquet(spark, d):
    path = scratch(spark, "points")
    f3(spark, d).withColumnsRenamed({"x": "e", "y": "n"}).write.parquet(path)
    return read_points(spark, path, "e", "n", "z").select("point_id", "x", "y", "z")


@query("vector_csv", "SELECT CAST(feature_id AS VARCHAR) AS feature_id, format('POLYGON (({} {}, {} {}, {} {}, {} {}, {} {}))', CAST(xmin AS INT), CAST(ymin AS INT), CAST(xmax AS INT), CAST(ymin AS INT), CAST(xmax AS INT), CAST(ymax AS INT), CAST(xmin AS INT), CAST(ymax AS INT), CAST(xmin AS INT), CAST(ymin AS INT)) AS geom FROM f4", SQL_F4)
def vector_csv(spark, d):
    path = scratch(spark, "features")
    write_csv(f4(spark, d), path, ";")
    return spark.read.option("header", True).option("sep", ";").csv(path).select("feature_id", "geom")


@query("vector_parquet", "SELECT feature_id, attr, 2000.0::DOUBLE AS area, 3857 AS crs FROM f4", SQL_F4)
def vector_parquet(spark, d):
    from strataframe.operators.features import Vector

    path = scratch(spark, "features")
    Vector(f4(spark, d), 3857).to_parquet(path)
    back = Vector.from_parquet(spark, path)
    return back.df.select("feature_id", "attr", G.area("geom").alias("area"), F.lit(back.crs).alias("crs"))


# --- rasters of different grids and reference systems


@query("stack_different", "SELECT 1 AS band, row + 2 AS row, col, value FROM f2 UNION ALL SELECT 2, row, col + 10, value FROM f5 WHERE value IS NOT NULL", SQL_F2, SQL_F5)
def stack_different(spark, d):
    """The second raster two rows up and ten columns on."""
    made = resample.stack_rasters([f2(spark, d), f5(spark, d).translate(10.0, 2.0)])
    return made.df.where("value IS NOT NULL").select("band", "row", "col", "value")


@query("merge_different", f"SELECT row, col, {r8('avg(value)')} AS value FROM (SELECT row + 2 AS row, col, value FROM f2 UNION ALL SELECT row, col + 10, value FROM f5) GROUP BY row, col HAVING count(value) > 0", SQL_F2, SQL_F5)
def merge_different(spark, d):
    made = resample.merge_rasters([f2(spark, d), f5(spark, d).translate(10.0, 2.0)], ["mean"])
    return rounded(made.df.where("value IS NOT NULL").select("row", "col", "value"), digits=8)


@query("load_multiple", "SELECT 0 AS raster, row, col - 10 AS col, value FROM f2 WHERE col >= 10 AND row < 5 UNION ALL SELECT 1, row - 2, col, value FROM f5 WHERE col < 40 AND row >= 2", SQL_F2, SQL_F5)
def load_multiple(spark, d):
    a, b = resample.load_multiple([f2(spark, d), f5(spark, d).translate(10.0, 2.0)])
    return a.df.select(F.lit(0).alias("raster"), "row", "col", "value").unionAll(b.df.select(F.lit(1), "row", "col", "value"))


_X = "(c + 0.5::DOUBLE) * 0.5::DOUBLE"
_SHIFT = "SELECT t.r AS row, t.c AS col, sum(v * w) / sum(w) AS value FROM (SELECT f5.row AS r0, f5.col AS c0, f5.value AS v FROM f5 WHERE value IS NOT NULL) s, (SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM range(5) p(r), range(20) q(c)) t, LATERAL (SELECT greatest(0, least(c0 + 1, 0.5::DOUBLE + t.c * 2.5::DOUBLE + 2.5::DOUBLE) - greatest(c0, 0.5::DOUBLE + t.c * 2.5::DOUBLE)) * greatest(0, least(r0 + 1, 0.5::DOUBLE + t.r * 1.5::DOUBLE + 1.5::DOUBLE) - greatest(r0, 0.5::DOUBLE + t.r * 1.5::DOUBLE)) AS w) WHERE w > 1e-9 GROUP BY t.r, t.c"


@query("resample_average_shifted", f"SELECT row, col, {r11('value')} AS value FROM ({_SHIFT})", SQL_F5)
def resample_average_shifted(spark, d):
    """Area weights on a grid whose lines cut the source's cells."""
    made = resample.resample(f5(spark, d), Grid(2.5, 0.0, 0.5, 0.0, -1.5, 6.5, 5, 20), "average")
    return rounded(made.df.where("value IS NOT NULL").select("row", "col", "value"), digits=11)


@query("resample_average_finer", "SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, f5.value FROM range(14) p(r), range(100) q(c) JOIN f5 ON f5.row = r // 2 AND f5.col = c // 2", SQL_F5)
def resample_average_finer(spark, d):
    return resample.resample(f5(spark, d), Grid(0.5, 0.0, 0.0, 0.0, -0.5, 7.0, 14, 100), "max").df.select("row", "col", "value")


def _kernel_sql(kernel: str) -> str:
    weigh = lambda x: kernel.replace("@", f"abs({x})")
    return f"SELECT r AS row, c AS col, {r6('sum(w * f2.value) / sum(w)')} AS value FROM (SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, 0.25::DOUBLE + r * 0.5::DOUBLE - 0.5::DOUBLE + 0.1::DOUBLE AS i, 0.25::DOUBLE + c * 0.5::DOUBLE - 0.5::DOUBLE + 0.3::DOUBLE AS j FROM range(13) p(r), range(98) q(c)) t JOIN f2 ON abs(f2.row - i) <= 3 AND abs(f2.col - j) <= 3, LATERAL (SELECT ({weigh('f2.row - i')}) * ({weigh('f2.col - j')}) AS w) GROUP BY r, c"


_CUBIC = "CASE WHEN @ <= 1 THEN (1.5::DOUBLE * @ - 2.5::DOUBLE) * @ * @ + 1 WHEN @ < 2 THEN ((-0.5::DOUBLE * @ + 2.5::DOUBLE) * @ - 4) * @ + 2 ELSE 0 END"
_BSPLINE = "CASE WHEN @ <= 1 THEN (4 - 6 * @ * @ + 3 * @ * @ * @) / 6.0::DOUBLE WHEN @ < 2 THEN pow(2 - @, 3) / 6.0::DOUBLE ELSE 0 END"
_LANCZOS = "CASE WHEN @ < 1e-12 THEN 1 WHEN @ < 3 THEN 3 * sin(@ * pi()) * sin(@ * pi() / 3) / (@ * @ * pi() * pi()) ELSE 0 END"
for _n, _k in (("cubic", _CUBIC), ("cubic_spline", _BSPLINE), ("lanczos", _LANCZOS)):
    query(f"resample_{_n}", _kernel_sql(_k), SQL_F2)(lambda spark, d, n=_n: rounded(resample.resample(f2(spark, d), Grid(0.5, 0.0, 0.3, 0.0, -0.5, 6.9, 13, 98), n).df.select("row", "col", "value")))


@query("reproject_round_trip", "SELECT true AS near, true AS system, true AS inside")
def reproject_round_trip(spark, d):
    """A plane of columns and rows in UTM, in longitude and latitude and back: what is far from the edge is where it was."""
    grid = Grid(100.0, 0.0, 480000.0, 0.0, -100.0, 4650000.0, 40, 40, 32631)
    cells = spark.range(1600).select(F.lit(1).alias("band"), (F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"), (F.floor(F.col("id") / 40) + 3 * (F.col("id") % 40)).cast("double").alias("value"))
    plane = Raster(cells, grid)
    there = resample.reproject(plane, crs=4326)
    back = resample.reproject(Raster(store(there.df, "there"), there.grid), ref=grid)
    both = back.df.join(plane.df.withColumnRenamed("value", "was"), ["band", "row", "col"]).where("row BETWEEN 5 AND 34 AND col BETWEEN 5 AND 34")
    return both.agg((F.max(F.abs(F.col("value") - F.col("was"))) < 0.05).alias("near"), F.lit(there.grid.crs == 4326).alias("system"), (F.count("value") == 900).alias("inside"))


@query("raster_polygon_mask", f"SELECT count(*) FILTER (value) AS held, count(*) AS n FROM (SELECT (c + 0.5) * 4 > xmin AND (c + 0.5) * 4 < xmax AND 150 - (r + 0.5) * 2.5 > ymin AND 150 - (r + 0.5) * 2.5 < ymax AS value FROM range(60) p(r), range(180) q(c), (SELECT * FROM f4 WHERE feature_id = (SELECT max(feature_id) FROM f4)) f)", SQL_F4)
def raster_polygon_mask(spark, d):
    """The mask of the last rectangle, as a count: how many cells it holds."""
    last = f4(spark, d).join(f4(spark, d).agg(F.max("feature_id").alias("feature_id")), "feature_id")
    mask = vector.create_mask(last, Grid(4.0, 0.0, 0.0, 0.0, -2.5, 150.0, 60, 180))
    return mask.df.agg(F.count_if("value").alias("held"), F.count(F.lit(1)).alias("n"))


@query("classes_equal", "SELECT row, col, value = 1 AS value FROM f6", SQL_F6)
def classes_equal(spark, d):
    return f6(spark, d).compare("eq", 1.0).df.select("row", "col", "value")


# --- interpolation of higher order, on surfaces that it must give back

_PLACES = "at_ AS (SELECT point_id, 7 - y AS i, x AS j FROM f7)"
_INSIDE = "i >= 0 AND j >= 0 AND i <= 6 AND j <= 49"
for _n, _surface, _sql in (("cubic", lambda: F.pow(F.col("row") - 3, F.lit(3)) + F.col("row") * F.col("col"), "pow(i - 3, 3) + i * j"), ("quintic", lambda: F.pow((F.col("row") - 3) / 2, F.lit(5)) + F.pow(F.col("col") / 10, F.lit(4)), "pow((i - 3) / 2, 5) + pow(j / 10, 4)"), ("splinef2d", lambda: F.col("row") * F.col("row") - F.col("col"), "i * i - j"), ("slinear", lambda: F.col("row") * 2.0 + F.col("col"), "i * 2 + j"), ("pchip", lambda: F.col("row") * 2.0 - F.col("col"), "i * 2 - j")):
    query(f"interp_{_n}", f"SELECT point_id, {r6(f'CASE WHEN {_INSIDE} THEN {_sql} END')} AS value FROM at_", SQL_F7, _PLACES)(
        lambda spark, d, n=_n, surface=_surface: rounded(interp(f2(spark, d).with_value(surface().cast("double")), f7(spark, d), n))
    )
