"""Queries of the geometry kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions import geometry as G
from strataframe.functions import kernels as K
from strataframe.queries.fixtures import SQL_F4, f4
from strataframe.queries.rasters import r6, rounded

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(run):
        QUERIES[name] = run
        ORACLES[name] = f"WITH {SQL_F4} {sql}"
        return run

    return add


def _moved(spark, d):
    return f4(spark, d).select("feature_id", "geom", G.translate("geom", 3.0, -2.0).alias("other"))


@query("shape_hulls", f"SELECT feature_id, 2000.0::DOUBLE AS hull, 2000.0::DOUBLE AS rect, {r6('sqrt(100 * 100 + 20 * 20) / 2')} AS radius, 5 AS n FROM f4")
def shape_hulls(spark, d):
    made = f4(spark, d).select("feature_id", K.convex_hull("geom").alias("h"), K.minimum_rotated_rectangle("geom").alias("r"), K.minimum_bounding_radius("geom").alias("radius"), K.simplify(G.translate("geom", 1.0), F.lit(0.01)).alias("s"))
    return rounded(made.select("feature_id", G.area("h").alias("hull"), G.area("r").alias("rect"), "radius", G.count_coordinates("s").alias("n")), "hull", "rect", "radius")


@query("shape_distances", f"SELECT feature_id, {r6('sqrt(13.0)')} AS hausdorff, {r6('sqrt(13.0)')} AS frechet, 0.0::DOUBLE AS distance, {r6('sqrt(50 * 50 + 30 * 30)')} AS apart, 110.0::DOUBLE AS project FROM f4")
def shape_distances(spark, d):
    far = G.translate("geom", 150.0, 50.0)
    b = G.bounds("geom")
    line = F.struct(F.lit("LineString").alias("type"), F.col("geom.parts").alias("parts"))
    out = _moved(spark, d).select("feature_id", K.hausdorff_distance("geom", "other").alias("hausdorff"), K.frechet_distance("geom", "other").alias("frechet"), K.st_distance("geom", "other").alias("distance"), K.st_distance("geom", far).alias("apart"), K.project(line, b["right"] + 5, b["bottom"] + 10).alias("project"))
    return rounded(out, "hausdorff", "frechet", "distance", "apart", "project")


@query("shape_relations", "SELECT feature_id, true AS intersects, false AS disjoint, true AS overlaps, false AS touches, true AS within, true AS covers, true AS properly, true AS valid, true AS simple, true AS edge FROM f4")
def shape_relations(spark, d):
    small, beside = G.scale("geom", 0.5, 0.5), G.translate("geom", 100.0, 0.0)
    return _moved(spark, d).select(
        "feature_id", K.st_intersects("geom", "other").alias("intersects"), K.st_disjoint("geom", "other").alias("disjoint"), K.st_overlaps("geom", "other").alias("overlaps"), K.st_touches("geom", "other").alias("touches"),
        K.st_within(small, "geom").alias("within"), K.st_covers("geom", small).alias("covers"), K.st_contains_properly("geom", small).alias("properly"), K.st_is_valid("geom").alias("valid"), K.st_is_simple("geom").alias("simple"), K.st_touches("geom", beside).alias("edge"),
    )


@query("shape_intersection", f"SELECT feature_id, {r6('97.0 * 18.0')} AS area FROM f4")
def shape_intersection(spark, d):
    return rounded(_moved(spark, d).select("feature_id", G.area(K.intersection_convex("geom", "other")).alias("area")), "area")


@query("shape_wkb_round_trip", "SELECT feature_id, 93 AS bytes, true AS same FROM f4")
def shape_wkb_round_trip(spark, d):
    wkb = f4(spark, d).select("feature_id", "geom", K.to_wkb("geom").alias("wkb"))
    return wkb.select("feature_id", F.octet_length("wkb").alias("bytes"), G.equals_exact("geom", K.from_wkb("wkb")).alias("same"))


@query("shape_triangles", "SELECT feature_id, 2 AS triangles, 2000.0::DOUBLE AS area FROM f4")
def shape_triangles(spark, d):
    t = K.delaunay_triangles("geom")
    return rounded(f4(spark, d).select("feature_id", t.alias("t")).select("feature_id", G.count_geometries("t").alias("triangles"), G.area("t").alias("area")), "area")
