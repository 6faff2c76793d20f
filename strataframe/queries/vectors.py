"""Queries of the feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions import geometry as G
from strataframe.functions import names
from strataframe.operators import vector
from strataframe.operators.stats import get_stats
from strataframe.plans.grid import Grid, align_bounds, merge_bounds
from strataframe.queries.fixtures import SQL_F3, SQL_F4, f3, f4
from strataframe.queries.rasters import r6, rounded

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, *fixtures: str):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = (f"WITH {', '.join(fixtures)} " if fixtures else "") + sql
        return run

    return add


_HELD = "f3.x BETWEEN xmin AND xmax AND f3.y BETWEEN ymin AND ymax AND f3.x < xmax AND f3.y < ymax"


@query("sjoin_within", f"SELECT point_id, feature_id, attr FROM f3 JOIN f4 ON {_HELD}", SQL_F3, SQL_F4)
def sjoin_within(spark, d):
    return vector.sjoin_points(f3(spark, d), f4(spark, d)).select("point_id", "feature_id", "attr")


@query("sjoin_left", f"SELECT point_id, coalesce(feature_id, -1) AS feature_id FROM f3 LEFT JOIN f4 ON {_HELD}", SQL_F3, SQL_F4)
def sjoin_left(spark, d):
    return vector.sjoin_points(f3(spark, d), f4(spark, d), "left").select("point_id", F.coalesce("feature_id", F.lit(-1)).alias("feature_id"))


@query("sjoin_semi", f"SELECT point_id, z FROM f3 WHERE EXISTS (SELECT 1 FROM f4 WHERE {_HELD})", SQL_F3, SQL_F4)
def sjoin_semi(spark, d):
    return vector.sjoin_points(f3(spark, d), f4(spark, d), "semi").select("point_id", "z")


@query("sjoin_anti", f"SELECT point_id, z FROM f3 WHERE NOT EXISTS (SELECT 1 FROM f4 WHERE {_HELD})", SQL_F3, SQL_F4)
def sjoin_anti(spark, d):
    return vector.sjoin_points(f3(spark, d), f4(spark, d), "anti").select("point_id", "z")


@query("zonal_stats", f"SELECT feature_id, {r6('avg(z)')} AS mean, {r6('median(z)')} AS median, {r6('stddev_pop(z)')} AS std, count(z) AS valid_count FROM f3 JOIN f4 ON {_HELD} GROUP BY feature_id", SQL_F3, SQL_F4)
def zonal_stats(spark, d):
    held = vector.sjoin_points(f3(spark, d), f4(spark, d))
    return rounded(get_stats(held, "z", ["mean", "median", "std", "valid_count"], ["feature_id"]), "mean", "median", "std")


_GAP = "sqrt(pow(greatest(xmin - x, x - xmax, 0), 2) + pow(greatest(ymin - y, y - ymax, 0), 2))"


@query("sjoin_nearest", f"SELECT point_id, feature_id, {r6('g')} AS distance FROM (SELECT point_id, feature_id, {_GAP} AS g FROM f3, f4) WHERE g <= 15 QUALIFY rank() OVER (PARTITION BY point_id ORDER BY round(g, 9)) = 1", SQL_F3, SQL_F4)
def sjoin_nearest(spark, d):
    return rounded(vector.sjoin_nearest(f3(spark, d), f4(spark, d), 15.0), "distance")


@query("dissolve_by_attr", "SELECT attr, min(feature_id) AS first_id, count(*) AS parts, 2000.0::DOUBLE * count(*) AS area FROM f4 GROUP BY attr", SQL_F4)
def dissolve_by_attr(spark, d):
    out = vector.dissolve(f4(spark, d), "attr", [F.min("feature_id").alias("first_id")])
    return out.select("attr", "first_id", G.count_geometries("geom").cast("bigint").alias("parts"), G.area("geom").alias("area"))


@query("total_bounds", 'SELECT min(xmin) AS "left", min(ymin) AS bottom, max(xmax) AS "right", max(ymax) AS top FROM f4', SQL_F4)
def total_bounds(spark, d):
    return vector.total_bounds(f4(spark, d))


@query("overlay_rect", "SELECT a.feature_id AS left_id, b.feature_id AS right_id, greatest(a.xmin, b.xmin + 60) AS xmin, greatest(a.ymin, b.ymin + 10) AS ymin, least(a.xmax, b.xmax + 60) AS xmax, least(a.ymax, b.ymax + 10) AS ymax FROM f4 a, f4 b WHERE greatest(a.xmin, b.xmin + 60) < least(a.xmax, b.xmax + 60) AND greatest(a.ymin, b.ymin + 10) < least(a.ymax, b.ymax + 10)", SQL_F4)
def overlay_rect(spark, d):
    a = f4(spark, d)
    b = a.select("feature_id", *[(F.col(c) + (60 if c[0] == "x" else 10)).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    return vector.overlay_boxes(a, b)


@query("vector_crop_clip", f"SELECT feature_id, {r6('greatest(0, least(xmax, 300) - greatest(xmin, 50)) * greatest(0, least(ymax, 75) - greatest(ymin, 10))')} AS area FROM f4 WHERE xmin < 300 AND xmax > 50 AND ymin < 75 AND ymax > 10", SQL_F4)
def vector_crop_clip(spark, d):
    return rounded(vector.crop(f4(spark, d), (50.0, 10.0, 300.0, 75.0), clip=True).select("feature_id", G.area("geom").alias("area")), "area")


@query("vector_measures", f"SELECT feature_id, 2000.0::DOUBLE AS area, 240.0::DOUBLE AS length, {r6('(xmin + xmax) / 2')} AS cx, {r6('(ymin + ymax) / 2')} AS cy, true AS closed, true AS ccw, 5 AS n, 0 AS holes FROM f4", SQL_F4)
def vector_measures(spark, d):
    c = G.centroid("geom")
    return rounded(f4(spark, d).select("feature_id", G.area("geom").alias("area"), G.length("geom").alias("length"), c["x"].alias("cx"), c["y"].alias("cy"), G.is_closed("geom").alias("closed"), G.is_ccw("geom").alias("ccw"), G.count_coordinates("geom").alias("n"), G.count_interior_rings("geom").alias("holes")), "area", "length", "cx", "cy")


_MOVES = {
    "translate": (lambda: G.translate("geom", 3.0, -2.0), "xmin + 3", "ymin - 2", "xmax + 3", "ymax - 2"),
    "scale": (lambda: G.scale("geom", 2.0, 0.5), "xmin - 50", "ymin + 5", "xmax + 50", "ymax - 5"),
    "rotate": (lambda: G.rotate("geom", 90.0), "(xmin + xmax) / 2 - 10", "(ymin + ymax) / 2 - 50", "(xmin + xmax) / 2 + 10", "(ymin + ymax) / 2 + 50"),
    "affine": (lambda: G.affine("geom", (0.0, 2.0, 1.0, 0.0, 5.0, 6.0)), "2 * ymin + 5", "xmin + 6", "2 * ymax + 5", "xmax + 6"),
    "skew": (lambda: G.skew("geom", 45.0, 0.0), "xmin - 10", "ymin", "xmax + 10", "ymax"),
    "envelope": (lambda: G.envelope("geom"), "xmin", "ymin", "xmax", "ymax"),
    "precision": (lambda: G.set_precision("geom", 8.0), "round_even(xmin / 8, 0) * 8", "round_even(ymin / 8, 0) * 8", "round_even(xmax / 8, 0) * 8", "round_even(ymax / 8, 0) * 8"),
}
for _n, (_move, *_sql) in _MOVES.items():

    def _moved(spark, d, move=_move):
        b = G.bounds("moved")
        return rounded(f4(spark, d).withColumn("moved", move()).select("feature_id", *[b[c].alias(c) for c in ("left", "bottom", "right", "top")]), "left", "bottom", "right", "top")

    query(f"vector_{_n}", "SELECT feature_id, " + ", ".join(f'{r6(e)} AS "{c}"' for e, c in zip(_sql, ("left", "bottom", "right", "top"), strict=True)) + " FROM f4", SQL_F4)(_moved)


@query("vector_segmentize", "SELECT feature_id, CAST(1 + 2 * ceil(100 / 30.0) + 2 * ceil(20 / 30.0) AS INT) AS n, 240.0::DOUBLE AS length FROM f4", SQL_F4)
def vector_segmentize(spark, d):
    return rounded(f4(spark, d).select("feature_id", G.segmentize("geom", 30.0).alias("geom")).select("feature_id", G.count_coordinates("geom").alias("n"), G.length("geom").alias("length")), "length")


@query("vector_wkt", "SELECT feature_id, format('POLYGON (({} {}, {} {}, {} {}, {} {}, {} {}))', CAST(xmin AS INT), CAST(ymin AS INT), CAST(xmax AS INT), CAST(ymin AS INT), CAST(xmax AS INT), CAST(ymax AS INT), CAST(xmin AS INT), CAST(ymax AS INT), CAST(xmin AS INT), CAST(ymin AS INT)) AS wkt FROM f4", SQL_F4)
def vector_wkt(spark, d):
    return f4(spark, d).select("feature_id", G.to_wkt("geom").alias("wkt"))


@query("vector_distance", f"SELECT point_id, {r6('min(' + _GAP + ')')} AS distance FROM f3, f4 WHERE feature_id = 7 GROUP BY point_id", SQL_F3, SQL_F4)
def vector_distance(spark, d):
    one = f4(spark, d).where("feature_id = 7").select("geom")
    return rounded(f3(spark, d).crossJoin(F.broadcast(one)).select("point_id", G.distance_to_point("geom", F.col("x"), F.col("y")).alias("distance")), "distance")  # one feature


@query("vector_distances", f"SELECT point_id, feature_id, {r6(_GAP)} AS distance FROM f3, f4", SQL_F3, SQL_F4)
def vector_distances(spark, d):
    return rounded(vector.distances(f3(spark, d), f4(spark, d)), "distance")


_GROUND = Grid(4.0, 0.0, 0.0, 0.0, -2.5, 150.0, 60, 180)


@query("rasterize", "SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, coalesce(max(feature_id), -1)::DOUBLE AS value FROM range(60) p(r), range(180) q(c) LEFT JOIN f4 ON (c + 0.5) * 4 > xmin AND (c + 0.5) * 4 < xmax AND 150 - (r + 0.5) * 2.5 > ymin AND 150 - (r + 0.5) * 2.5 < ymax GROUP BY r, c", SQL_F4)
def rasterize(spark, d):
    return vector.rasterize(f4(spark, d), _GROUND, None, -1.0).df.select("row", "col", "value")


@query("create_mask", "SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, count(feature_id) > 0 AS value FROM range(60) p(r), range(180) q(c) LEFT JOIN f4 ON (c + 0.5) * 4 > xmin AND (c + 0.5) * 4 < xmax AND 150 - (r + 0.5) * 2.5 > ymin AND 150 - (r + 0.5) * 2.5 < ymax GROUP BY r, c", SQL_F4)
def create_mask(spark, d):
    return vector.create_mask(f4(spark, d), _GROUND).df.select("row", "col", "value")


_TILES = ["N45E006", "S10W123", "N00E000", "S01E179", "W123S10"]


@query("parse_tile_names", "SELECT * FROM (VALUES ('N45E006', 45.0::DOUBLE, 6.0::DOUBLE), ('S10W123', -10.0, -123.0), ('N00E000', 0.0, 0.0), ('S01E179', -1.0, 179.0), ('W123S10', -10.0, -123.0)) t(name, lat, lon)")
def parse_tile_names(spark, d):
    t = spark.createDataFrame([(n,) for n in _TILES], "name string")
    c = names.tile_corner(F.col("name"))
    return t.select("name", (c["lat"] + 0.0).alias("lat"), (c["lon"] + 0.0).alias("lon"))


@query("parse_scenes", "SELECT * FROM (VALUES ('LE71400412000304SGS00_B4', 'Landsat 7', 'ETM+', '140041', '2000-10-30'), ('LC08_L1TP_140041_20150304_20170412_01_T1', 'Landsat 8', 'OLI/TIRS', '140041', '2015-03-04'), ('T18XWL_20180501T100019_B04', 'Sentinel-2', 'MSI', '18XWL', '2018-05-01'), ('N45E006', NULL, NULL, 'N45E006', NULL)) t(name, platform, sensor, tile, date)")
def parse_scenes(spark, d):
    t = spark.createDataFrame([("LE71400412000304SGS00_B4",), ("LC08_L1TP_140041_20150304_20170412_01_T1",), ("T18XWL_20180501T100019_B04",), ("N45E006",)], "name string")
    return t.select("name", names.scene(F.col("name")).alias("s")).select("name", "s.platform", "s.sensor", "s.tile", F.col("s.date").cast("string").alias("date"))


@query("bounds_rules", 'SELECT * FROM (VALUES (\'union\', 0.0::DOUBLE, -2.0::DOUBLE, 12.0::DOUBLE, 8.0::DOUBLE), (\'intersection\', 3.0, 0.0, 10.0, 5.0), (\'aligned\', 0.0, -10.0, 15.0, 10.0)) t(rule, "left", bottom, "right", top)')
def bounds_rules(spark, d):
    boxes = [(0.0, 0.0, 10.0, 8.0), (3.0, -2.0, 12.0, 5.0)]
    rows = [("union", *merge_bounds(boxes)), ("intersection", *merge_bounds(boxes, how="intersection")), ("aligned", *align_bounds(Grid(5.0, 0.0, 0.0, 0.0, -5.0, 10.0, 4, 4), (1.0, -6.0, 12.0, 7.0)))]
    return spark.createDataFrame([(r, *map(float, b)) for r, *b in rows], "rule string, left double, bottom double, right double, top double")
