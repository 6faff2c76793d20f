"""Queries of joins, overlays, buffers and topology of features, on rectangles, triangles and lines over the same corners."""

from __future__ import annotations


from pyspark.sql import functions as F

from strataframe.functions import geometry as G
from strataframe.functions import kernels as K
from strataframe.functions.crs import reproject_shape
from strataframe.operators import vector
from strataframe.operators.features import Vector
from strataframe.plans.grid import Grid
from strataframe.queries.fixtures import SQL_F4, f4
from strataframe.queries.rasters import r6, rounded

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(run):
        QUERIES[name] = run
        ORACLES[name] = f"WITH {SQL_F4} {sql}"
        return run

    return add


def corners(*spots: tuple[str, str]):
    """A closed ring of expressions of xmin, ymin, xmax and ymax."""
    return F.array(*[G.vertex(F.expr(x), F.expr(y)) for x, y in [*spots, spots[0]]])


def triangles(spark, d, dx=0.0, dy=0.0):
    """The lower left halves of the rectangles, moved."""
    ring = corners(("xmin", "ymin"), ("xmax", "ymin"), ("xmin", "ymax"))
    return f4(spark, d).withColumn("geom", G.translate(G.polygon(ring), dx, dy))


def lines(*spots: tuple[str, str]):
    return F.struct(F.lit("LineString").alias("type"), F.array(F.array(F.array(*[G.vertex(F.expr(x), F.expr(y)) for x, y in spots]))).alias("parts"))


def moved(spark, d, dx, dy):
    return f4(spark, d).withColumn("geom", G.translate("geom", dx, dy))


def measured(df, *more):
    return rounded(df.select(*more, G.area("geom").alias("area")), "area")


# --- overlays: a triangle moved by (50, 5) shares 687.5 with its own rectangle and 3.6 with the next one's

_BOTH = "SELECT a.feature_id AS left_id, b.feature_id AS right_id, CASE WHEN a.feature_id = b.feature_id THEN 687.5::DOUBLE ELSE 3.6::DOUBLE END AS area FROM f4 a JOIN f4 b ON a.feature_id = b.feature_id OR (a.feature_id = b.feature_id + 1 AND b.feature_id % 5 < 4)"
_LEFT = f"SELECT feature_id AS left_id, NULL::BIGINT AS right_id, {r6('2000 - 687.5::DOUBLE - CASE WHEN feature_id % 5 > 0 THEN 3.6::DOUBLE ELSE 0 END')} AS area FROM f4"
_RIGHT = f"SELECT NULL::BIGINT AS left_id, feature_id AS right_id, {r6('1000 - 687.5::DOUBLE - CASE WHEN feature_id % 5 < 4 THEN 3.6::DOUBLE ELSE 0 END')} AS area FROM f4"
for _how, _parts in {"intersection": [_BOTH], "union": [_BOTH, _LEFT, _RIGHT], "identity": [_BOTH, _LEFT], "difference": [_LEFT], "symmetric_difference": [_LEFT, _RIGHT]}.items():
    query(f"overlay_{_how}", " UNION ALL ".join(_parts))(lambda spark, d, how=_how: measured(vector.overlay_features(f4(spark, d), triangles(spark, d, 50.0, 5.0), how), "left_id", "right_id"))
for _rule, _area in {"union": 2312.5, "intersection": 687.5, "difference": 1312.5, "symmetric_difference": 1625.0}.items():
    query(f"pairwise_{_rule}", f"SELECT feature_id, {_area}::DOUBLE AS area FROM f4")(lambda spark, d, rule=_rule: measured(getattr(Vector(f4(spark, d)), rule)(Vector(triangles(spark, d, 50.0, 5.0))).df, "feature_id"))


@query("union_all", "SELECT 79450.0::DOUBLE AS area")
def union_all(spark, d):
    """Rectangles and their copies moved by (50, 5), which meet each other and the next."""
    return measured(Vector(f4(spark, d).unionAll(moved(spark, d, 50.0, 5.0))).union_all())


@query("intersection_all", "SELECT 1520.0::DOUBLE AS area")
def intersection_all(spark, d):
    ring = corners(("feature_id", "0"), ("feature_id + 100", "0"), ("feature_id + 100", "20"), ("feature_id", "20"))
    return measured(Vector(f4(spark, d).withColumn("geom", G.polygon(ring))).intersection_all())


@query("dissolve_overlapping", "SELECT feature_id, 2 AS n, 3250.0::DOUBLE AS area FROM f4")
def dissolve_overlapping(spark, d):
    out = vector.dissolve(f4(spark, d).unionAll(moved(spark, d, 50.0, 5.0)), "feature_id", [F.count(F.lit(1)).cast("int").alias("n")])
    return rounded(out.select("feature_id", "n", G.area("geom").alias("area")), "area")


@query("vector_clip", "SELECT feature_id, attr, CASE WHEN feature_id % 5 > 0 THEN 691.1::DOUBLE ELSE 687.5::DOUBLE END AS area FROM f4")
def vector_clip(spark, d):
    return measured(Vector(f4(spark, d)).clip(Vector(triangles(spark, d, 50.0, 5.0))).df, "feature_id", "attr")


# --- joins


def joined(spark, d, other, predicate, **more):
    return vector.sjoin(f4(spark, d), other, predicate, **more).select(F.col("feature_id").alias("left_id"), F.col("feature_id_right").alias("right_id"))


_PAIRS = "SELECT a.feature_id AS left_id, b.feature_id AS right_id FROM f4 a JOIN f4 b ON "
_MEET = "a.xmin <= b.xmax + 60 AND b.xmin + 60 <= a.xmax AND a.ymin <= b.ymax + 15 AND b.ymin + 15 <= a.ymax"
query("sjoin_intersects", _PAIRS + _MEET)(lambda spark, d: joined(spark, d, moved(spark, d, 60.0, 15.0), "intersects"))
query("sjoin_overlaps", _PAIRS + _MEET)(lambda spark, d: joined(spark, d, moved(spark, d, 60.0, 15.0), "overlaps"))
query("sjoin_contains", _PAIRS + "a.feature_id = b.feature_id")(lambda spark, d: joined(spark, d, triangles(spark, d), "contains"))
query("sjoin_covers", _PAIRS + "a.feature_id = b.feature_id")(lambda spark, d: joined(spark, d, triangles(spark, d), "covers"))
query("sjoin_features_within", "SELECT feature_id AS left_id, feature_id AS right_id FROM f4")(lambda spark, d: vector.sjoin(triangles(spark, d), f4(spark, d), "within").select(F.col("feature_id").alias("left_id"), F.col("feature_id_right").alias("right_id")))
query("sjoin_covered_by", "SELECT feature_id AS left_id, feature_id AS right_id FROM f4")(lambda spark, d: vector.sjoin(triangles(spark, d), f4(spark, d), "covered_by").select(F.col("feature_id").alias("left_id"), F.col("feature_id_right").alias("right_id")))
query("sjoin_touches", _PAIRS + "a.feature_id = b.feature_id + 5")(lambda spark, d: joined(spark, d, moved(spark, d, 0.0, 10.0), "touches"))
query("sjoin_equals", _PAIRS + "a.feature_id = b.feature_id")(lambda spark, d: joined(spark, d, f4(spark, d).withColumn("geom", G.reverse("geom")), "equals"))
query("sjoin_crosses", _PAIRS + "a.feature_id = b.feature_id")(lambda spark, d: joined(spark, d, f4(spark, d).withColumn("geom", lines(("xmin - 5", "ymin + 3"), ("xmax + 5", "ymin + 4"))), "crosses"))
query("sjoin_properly", _PAIRS + "a.feature_id = b.feature_id")(lambda spark, d: joined(spark, d, f4(spark, d).withColumn("geom", G.scale("geom", 0.5, 0.5)), "contains_properly"))
_GAP = "sqrt(pow(greatest(a.xmin - b.xmax, b.xmin - a.xmax, 0), 2) + pow(greatest(a.ymin - b.ymax, b.ymin - a.ymax, 0), 2))"
query("sjoin_dwithin", _PAIRS + f"{_GAP} <= 45")(lambda spark, d: joined(spark, d, f4(spark, d), "dwithin", distance=45.0))


@query("sjoin_left_features", f"SELECT a.feature_id AS left_id, b.feature_id AS right_id FROM f4 a LEFT JOIN (SELECT * FROM f4 WHERE attr = 2) b ON {_MEET}")
def sjoin_left_features(spark, d):
    return joined(spark, d, moved(spark, d, 60.0, 15.0).where("attr = 2"), "intersects", how="left")


@query("sjoin_right_features", f"SELECT a.feature_id AS left_id, b.feature_id AS right_id FROM f4 b LEFT JOIN (SELECT * FROM f4 WHERE attr = 2) a ON {_MEET}")
def sjoin_right_features(spark, d):
    return vector.sjoin(f4(spark, d).where("attr = 2"), moved(spark, d, 60.0, 15.0), "intersects", "right").select(F.col("feature_id").alias("left_id"), F.col("feature_id_right").alias("right_id"))


# --- relations, feature by feature


@query("shape_relations_slanted", "SELECT feature_id, true AS contains, true AS covered_by, true AS crosses, false AS properly, true AS near, false AS far, true AS equals, '212111212' AS matrix, true AS pattern FROM f4")
def shape_relations_slanted(spark, d):
    t = G.polygon(corners(("xmin", "ymin"), ("xmax", "ymin"), ("xmin", "ymax")))
    over = G.translate(t, 50.0, 0.0)
    made = f4(spark, d).select("feature_id", "geom", t.alias("t"), over.alias("o"), lines(("xmin - 1", "ymin + 1"), ("xmax", "ymin + 7")).alias("l"), G.translate("geom", 103.0, 0.0).alias("n"))
    return made.select(
        "feature_id", K.st_contains("geom", "t").alias("contains"), K.st_covered_by("t", "geom").alias("covered_by"), K.st_crosses("l", "geom").alias("crosses"), K.st_contains_properly("geom", "t").alias("properly"),
        K.st_dwithin("geom", "n", F.lit(3.5)).alias("near"), K.st_dwithin("geom", "n", F.lit(2.5)).alias("far"), K.st_equals("geom", G.reverse("geom")).alias("equals"), K.st_relate("geom", "o").alias("matrix"), K.st_relate_pattern("geom", "o", F.lit("T*T***T**")).alias("pattern"),
    )


@query("shape_validity", f"SELECT feature_id, false AS valid, 'Self-intersection' AS reason, 1000.0::DOUBLE AS area, 2 AS parts, true AS ring, false AS open, {r6('20.0')} AS clearance FROM f4")
def shape_validity(spark, d):
    bow = G.polygon(corners(("xmin", "ymin"), ("xmax", "ymax"), ("xmax", "ymin"), ("xmin", "ymax")))
    outline = lines(("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymin"))
    made = f4(spark, d).select("feature_id", "geom", bow.alias("bow"), outline.alias("o"), lines(("xmin", "ymin"), ("xmax", "ymin")).alias("l"))
    made = made.select("feature_id", "geom", "o", "l", K.st_is_valid("bow").alias("valid"), K.st_is_valid_reason("bow").alias("reason"), K.st_make_valid("bow").alias("good"))
    return rounded(made.select("feature_id", "valid", "reason", G.area("good").alias("area"), G.count_geometries("good").alias("parts"), K.st_is_ring("o").alias("ring"), K.st_is_ring("l").alias("open"), K.st_minimum_clearance("geom").alias("clearance")), "area", "clearance")


# --- buffers and hulls

_FAN = "0.5::DOUBLE * 64 * {r} * {r} * sin(2 * pi() / 64)"
for _name, _size, _sql in (("out", 5.0, f"2000 + 240 * 5 + {_FAN.format(r=5)}"), ("in", -5.0, "90 * 10")):
    query(f"buffer_{_name}", f"SELECT feature_id, {r6(_sql)} AS area FROM f4")(lambda spark, d, size=_size: measured(vector.buffer(f4(spark, d), size), "feature_id"))
query("buffer_line", f"SELECT feature_id, {r6('100 * 10 + ' + _FAN.format(r=5))} AS area FROM f4")(lambda spark, d: measured(vector.buffer(f4(spark, d).withColumn("geom", lines(("xmin", "ymin"), ("xmax", "ymin"))), 5.0), "feature_id"))
query("buffer_metric", f"SELECT feature_id, {r6('2000 + 240 * 5 + ' + _FAN.format(r=5))} AS area FROM f4")(lambda spark, d: measured(vector.buffer_metric(moved(spark, d, 500000.0, 4649776.0), 5.0, 32631), "feature_id"))


@query("buffer_metric_geographic", f"SELECT feature_id, round(2000 + 240 * 5 + {_FAN.format(r=5)}, 2) + 0.0::DOUBLE AS area FROM f4")
def buffer_metric_geographic(spark, d):
    """Rectangles near a central meridian, grown by five metres in longitude and latitude."""
    there = vector.to_crs(moved(spark, d, 500000.0, 4649776.0), 32631, 4326)
    grown = vector.buffer_metric(there, 5.0, 4326)
    return rounded(vector.to_crs(grown, 4326, 32631).select("feature_id", G.area("geom").alias("area")), "area", digits=2)


@query("buffer_without_overlap", f"SELECT feature_id, {r6('240 * 4 + ' + _FAN.format(r=4))} AS area FROM f4")
def buffer_without_overlap(spark, d):
    return measured(vector.buffer_without_overlap(f4(spark, d), 4.0), "feature_id")


@query("buffer_without_overlap_shared", "SELECT feature_id, true AS half FROM f4")
def buffer_without_overlap_shared(spark, d):
    """Rings of eight around rectangles ten apart: no two share a place, and they end half-way to their neighbours."""
    rings = vector.buffer_without_overlap(f4(spark, d), 8.0)
    b = G.bounds("r.geom")
    both = f4(spark, d).alias("f").join(rings.alias("r"), F.expr("f.feature_id = r.feature_id"))
    top, bottom = F.when(F.expr("f.feature_id < 20"), F.col("ymax") + 5).otherwise(F.col("ymax") + 8), F.when(F.expr("f.feature_id >= 5"), F.col("ymin") - 5).otherwise(F.col("ymin") - 8)
    return both.select("f.feature_id", ((F.abs(b["top"] - top) < 1e-6) & (F.abs(b["bottom"] - bottom) < 1e-6)).alias("half"))


@query("shape_circles", f"SELECT feature_id, {r6(_FAN.format(r='sqrt(2600)'))} AS circle, 2000.0::DOUBLE AS concave FROM f4")
def shape_circles(spark, d):
    made = f4(spark, d).select("feature_id", K.st_minimum_bounding_circle("geom").alias("c"), K.st_concave_hull("geom", F.lit(1.0)).alias("h"))
    return rounded(made.select("feature_id", G.area("c").alias("circle"), G.area("h").alias("concave")), "circle", "concave")


@query("shape_voronoi", "SELECT feature_id, 4 AS cells, 8000.0::DOUBLE AS area, 500.0::DOUBLE AS smallest FROM f4")
def shape_voronoi(spark, d):
    """Voronoi cells of the corners inside the rectangle of twice the sides, which they fill; of triangles moved apart, the finite faces."""
    made = f4(spark, d).select("feature_id", K.st_voronoi_within("geom", G.scale("geom", 2.0, 2.0)).alias("v"), K.st_voronoi_within("geom", "geom").alias("own"))
    return rounded(made.select("feature_id", G.count_geometries("v").alias("cells"), G.area("v").alias("area"), (G.area("own") / 4).alias("smallest")), "area", "smallest")


@query("shape_voronoi_faces", "SELECT feature_id, 2 AS faces, 12.5::DOUBLE AS area FROM f4 WHERE feature_id = 0")
def shape_voronoi_faces(spark, d):
    """The finite faces of the Voronoi diagram of two unit squares five apart: two triangles."""
    ring = lambda x: ", ".join(f"named_struct('x', {x + a}d, 'y', {x + b}d)" for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))
    two = F.struct(F.lit("MultiPolygon").alias("type"), F.expr(f"array(array(array({ring(10)})), array(array({ring(5)})))").alias("parts"))
    made = f4(spark, d).where("feature_id = 0").select("feature_id", two.alias("geom")).select("feature_id", K.st_voronoi_faces("geom").alias("v"))  # one constant shape
    return rounded(made.select("feature_id", G.count_geometries("v").alias("faces"), (G.area("v") / 2).alias("area")), "area")


# --- lines


@query("shape_lines", f"SELECT feature_id, 1 AS merged, 120.0::DOUBLE AS length, 60.0::DOUBLE AS shared, {r6('3.0')} AS shortest, {r6('100.0 - 2 + 20 - 2')} AS beside FROM f4")
def shape_lines(spark, d):
    two = F.struct(F.lit("MultiLineString").alias("type"), F.array(F.array(F.expr("array(named_struct('x', xmin, 'y', ymin), named_struct('x', xmax, 'y', ymin))")), F.array(F.expr("array(named_struct('x', xmax, 'y', ymax), named_struct('x', xmax, 'y', ymin))"))).alias("parts"))
    bent = lines(("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"))
    made = f4(spark, d).select("feature_id", "geom", two.alias("two"), bent.alias("bent"), lines(("xmin + 40", "ymin"), ("xmax + 40", "ymin")).alias("along"))
    made = made.select("feature_id", K.st_line_merge("two").alias("m"), K.st_shared_paths("bent", "along").alias("s"), K.st_shortest_line("geom", G.translate("geom", 103.0, 0.0)).alias("n"), K.st_offset_curve("bent", F.lit(2.0)).alias("b"))
    return rounded(made.select("feature_id", G.count_geometries("m").alias("merged"), G.length("m").alias("length"), G.length("s").alias("shared"), G.length("n").alias("shortest"), G.length("b").alias("beside")), "length", "shared", "shortest", "beside")


@query("shape_faces", "SELECT feature_id, 2 AS faces, 2000.0::DOUBLE AS area, 2000.0::DOUBLE AS enclosed FROM f4")
def shape_faces(spark, d):
    frame = F.struct(F.lit("MultiLineString").alias("type"), F.concat(F.transform(G.rings("geom"), lambda r: F.array(r)), F.expr("array(array(array(named_struct('x', xmin + 30, 'y', ymin - 5), named_struct('x', xmin + 30, 'y', ymax + 5))))")).alias("parts"))
    made = f4(spark, d).select("feature_id", frame.alias("l")).select("feature_id", K.st_polygonize("l").alias("p"), K.st_build_area("l").alias("a"))
    return rounded(made.select("feature_id", G.count_geometries("p").alias("faces"), G.area("p").alias("area"), G.area("a").alias("enclosed")), "area", "enclosed")


@query("shape_snap", "SELECT feature_id, xmin AS left_, ymax + 10 AS top FROM f4")
def shape_snap(spark, d):
    """Corners less than two from the rectangle's are moved onto them."""
    near = G.polygon(corners(("xmin + 1", "ymin - 1"), ("xmax", "ymin"), ("xmin + 50", "ymax + 10")))
    made = f4(spark, d).select("feature_id", K.st_snap(near, "geom", F.lit(2.0)).alias("s"))
    b = G.bounds("s")
    return made.select("feature_id", b["left"].alias("left_"), b["top"].alias("top"))


# --- parts, vertices and types


@query("shape_parts", "SELECT feature_id, 1 AS holes, 240.0::DOUBLE AS outer_, 300.0::DOUBLE AS outline, 4 AS different, 5 AS kept, xmin AS first_x, 'Polygon' AS type, 0 AS exploded, false AS empty, true AS nothing FROM f4")
def shape_parts(spark, d):
    hole = corners(("xmin + 10", "ymin + 5"), ("xmin + 30", "ymin + 5"), ("xmin + 30", "ymin + 15"), ("xmin + 10", "ymin + 15"))
    holed = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(G.rings("geom")[0], hole)).alias("parts"))
    twice = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(F.flatten(F.transform(G.rings("geom")[0], lambda v: F.array(v, v))))).alias("parts"))
    made = vector.explode_parts(f4(spark, d).select("feature_id", "xmin", F.struct(F.lit("MultiPolygon").alias("type"), holed["parts"].alias("parts")).alias("geom"), twice.alias("twice"), holed.alias("holed"), F.col("geom").alias("plain")))
    none = F.struct(F.lit("Polygon").alias("type"), F.slice(F.col("plain.parts"), 1, 0).alias("parts"))
    outer = F.struct(F.lit("LineString").alias("type"), F.array(F.array(G.exterior("holed")[0])).alias("parts"))
    return rounded(
        made.select(
            "feature_id", F.size(G.interiors("holed")).alias("holes"), G.length(outer).alias("outer_"), G.length(G.boundary("holed")).alias("outline"), F.size(G.unique_points("plain")).alias("different"), G.count_coordinates(G.drop_repeated("twice")).alias("kept"),
            G.vertices(G.reverse("plain"))[0]["x"].alias("first_x"), G.geom_type(G.get_part("holed", 0)).alias("type"), F.col("part").alias("exploded"), G.is_empty("plain").alias("empty"), G.is_empty(none).alias("nothing"),
        ), "outer_", "outline",
    )


@query("shape_coordinates", "SELECT feature_id, CAST(k AS INT) AS k, CASE WHEN k IN (1, 2) THEN xmax ELSE xmin END AS x, CASE WHEN k IN (2, 3) THEN ymax ELSE ymin END AS y FROM f4, range(5) t(k)")
def shape_coordinates(spark, d):
    return f4(spark, d).select("feature_id", F.posexplode(G.vertices("geom")).alias("k", "v")).select("feature_id", "k", "v.x", "v.y")


@query("shape_places", "SELECT feature_id, true AS inside, xmin AS nx, ymin AS ny, xmin + 30 AS px, ymin AS py, 10.0::DOUBLE AS grain, 7.5::DOUBLE AS z, xmin * 2 AS tx FROM f4")
def shape_places(spark, d):
    made = f4(spark, d).select("feature_id", "geom", K.representative_point("geom").alias("r"), K.normalize("geom").alias("n"), K.interpolate(lines(("xmin", "ymin"), ("xmax", "ymin")), F.lit(30.0)).alias("p"))
    spot = lambda c: G.vertices(c)[0]
    high = G.force_3d("geom", 7.5)
    return made.select(
        "feature_id", G.contains_point("geom", spot("r")["x"], spot("r")["y"]).alias("inside"), spot("n")["x"].alias("nx"), spot("n")["y"].alias("ny"), spot("p")["x"].alias("px"), spot("p")["y"].alias("py"),
        (G.get_precision(G.scale("geom", 1.0, 1.0)) * 10).alias("grain"), F.flatten(F.flatten(high["parts"]))[0]["z"].alias("z"), G.vertices(G.force_2d(G.map_vertices("geom", lambda x, y: (x * 2, y))))[0]["x"].alias("tx"),
    )


@query("shape_hilbert", "SELECT count(*) AS n, count(DISTINCT feature_id) AS places, 0::BIGINT AS least FROM f4")
def shape_hilbert(spark, d):
    """Places along a Hilbert curve: one of its own for each rectangle, the first one at its start."""
    run = K.hilbert_distance((0.0, 0.0, 676.0, 140.0))
    made = f4(spark, d).select(run(F.col("xmin"), F.col("ymin")).alias("h"))
    return made.agg(F.count("h").alias("n"), F.count_distinct("h").alias("places"), F.min("h").alias("least"))


# --- reference systems


@query("vector_reproject", "SELECT feature_id, round(xmin + 500000, 3) + 0.0::DOUBLE AS x, round(ymin + 4649776, 3) + 0.0::DOUBLE AS y FROM f4")
def vector_reproject(spark, d):
    """UTM to longitude and latitude, to Web Mercator, and back."""
    there = Vector(moved(spark, d, 500000.0, 4649776.0), 32631).to_crs("EPSG:4326").reproject(crs=3857)
    v = G.vertices(reproject_shape("geom", 3857, 32631))[0]
    return rounded(there.df.select("feature_id", v["x"].alias("x"), v["y"].alias("y")), "x", "y", digits=3)


@query("vector_bounds_projected", f"SELECT {r6('degrees(0)')} AS left_, {r6('degrees(676 / 6378137.0::DOUBLE)')} AS right_, {r6('degrees(2 * atan(exp(140 / 6378137.0::DOUBLE)) - pi() / 2)')} AS top, 32631 AS metric, 5 AS corners, true AS same FROM f4 WHERE feature_id = 0")
def vector_bounds_projected(spark, d):
    v = Vector(f4(spark, d), 3857, "nations")
    box, ring = v.get_bounds_projected(4326, 50), v.get_footprint_projected(4326, 0)
    made = Vector.from_bounds_projected(spark, v, 4326, 50)
    same = all(abs(a - b) < 1e-12 for a, b in zip(made.total_bounds, box, strict=True)) and v.set_crs(3857).crs == 3857
    return rounded(spark.createDataFrame([(box.left, box.right, box.top, v.get_metric_crs(), len(ring), same)], "left_ double, right_ double, top double, metric int, corners int, same boolean"), "left_", "right_", "top")


# --- conversions


@query("vector_arrow_round_trip", "SELECT feature_id, attr, xmin, ymax, true AS same FROM f4")
def vector_arrow_round_trip(spark, d):
    """To Arrow with well-known binary and back, and through GeoJSON features."""
    v = Vector(f4(spark, d), 4326)
    back = Vector.from_arrow(spark, v.to_arrow(), crs=4326)
    again = Vector.from_features(spark, v.iterfeatures(), 4326).df.select("feature_id", F.col("geom").alias("other"))
    return back.df.join(again, "feature_id").select("feature_id", "attr", "xmin", "ymax", G.equals_exact("geom", "other").alias("same"))


@query("vector_geojson_round_trip", "SELECT feature_id, CAST(attr AS VARCHAR) AS attr, 2000.0::DOUBLE AS area FROM f4")
def vector_geojson_round_trip(spark, d):
    from strataframe.sources.io import features_from_geojson, features_to_geojson

    text = features_to_geojson(f4(spark, d))
    return features_from_geojson(text, "feature").select("feature_id", F.col("properties")["attr"].alias("attr"), G.area("geom").alias("area"))


@query("vector_query", "SELECT feature_id, attr, 'nations' AS name FROM f4 WHERE attr = 3 AND xmin < 300")
def vector_query(spark, d):
    v = Vector(f4(spark, d), 4326, "nations").query("attr = 3 AND xmin < 300").copy()
    return v.with_column("name", F.lit(v.name))[["feature_id", "attr", "name"]]


# --- to rasters

_GROUND = Grid(8.0, 0.0, -20.3, 0.0, -8.0, 170.3, 24, 92)
_CELL = "(-20.3::DOUBLE + c * 8) AS x0, (-20.3::DOUBLE + c * 8 + 8) AS x1, (170.3::DOUBLE - r * 8 - 8) AS y0, (170.3::DOUBLE - r * 8) AS y1"
_CELLS = f"cell AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, {_CELL} FROM range(24) p(r), range(92) q(c))"
_TOUCH = "x0 <= xmax AND x1 >= xmin AND y0 <= ymax AND y1 >= ymin"
ORACLES["rasterize_all_touched"] = f"WITH {SQL_F4}, {_CELLS} SELECT row, col, coalesce(max(feature_id), -1)::DOUBLE AS value FROM cell LEFT JOIN f4 ON {_TOUCH} GROUP BY row, col"
QUERIES["rasterize_all_touched"] = lambda spark, d: vector.rasterize(f4(spark, d), _GROUND, None, -1.0, all_touched=True).df.select("row", "col", "value")
_EDGE = f"edge AS (SELECT DISTINCT row, col FROM cell JOIN f4 ON {_TOUCH} AND NOT (x0 > xmin AND x1 < xmax AND y0 > ymin AND y1 < ymax))"
_FAR = r6("min(8 * sqrt((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)))")
ORACLES["proximity_vector"] = f"WITH {SQL_F4}, {_CELLS}, {_EDGE} SELECT a.row, a.col, {_FAR} AS value FROM cell a, edge b GROUP BY a.row, a.col"
QUERIES["proximity_vector"] = lambda spark, d: rounded(vector.vector_proximity(f4(spark, d), _GROUND).df.select("row", "col", "value"))
_HELD = "EXISTS (SELECT 1 FROM f4 WHERE (x0 + x1) / 2 > xmin AND (x0 + x1) / 2 < xmax AND (y0 + y1) / 2 > ymin AND (y0 + y1) / 2 < ymax)"
ORACLES["proximity_vector_out"] = f"WITH {SQL_F4}, {_CELLS}, {_EDGE}, far AS (SELECT a.row, a.col, {_FAR} AS v FROM cell a, edge b GROUP BY a.row, a.col) SELECT row, col, CASE WHEN {_HELD} THEN 0.0::DOUBLE ELSE v END AS value FROM cell JOIN far USING (row, col)"
QUERIES["proximity_vector_out"] = lambda spark, d: rounded(vector.vector_proximity(f4(spark, d), _GROUND, where="out").df.select("row", "col", "value"))
