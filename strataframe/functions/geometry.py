"""Geometries as ``struct<type, parts: polygons of rings of (x, y)>`` in column expressions.

A line is a part with one ring that need not close, a point a ring of one vertex. Nulls give nulls.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "struct<type: string, parts: array<array<array<struct<x: double, y: double>>>>>"


def _geom(g: str | Column) -> Column:
    return F.col(g) if isinstance(g, str) else g


def rings(g: str | Column) -> Column:
    return F.flatten(_geom(g)["parts"])


def vertices(g: str | Column) -> Column:
    return F.flatten(rings(g))


def polygon(ring: Column) -> Column:
    """Polygon of one ring."""
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.array(ring)).alias("parts"))


def point(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.array(F.array(vertex(x, y)))).alias("parts"))


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    corners = [(left, bottom), (right, bottom), (right, top), (left, top), (left, bottom)]
    return polygon(F.array(*[vertex(x, y) for x, y in corners]))


def _turn(ring: Column) -> Column:
    """Next vertex of each, the first after the last."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def signed_area(ring: Column) -> Column:
    """Positive if the ring turns counter-clockwise; open rings are closed. Reckoned from the first vertex, so far places keep their digits."""
    first = F.get(ring, 0)
    x, y = first["x"], first["y"]
    return _total(F.zip_with(ring, _turn(ring), lambda p, q: (p["x"] - x) * (q["y"] - y) - (q["x"] - x) * (p["y"] - y))) / 2


def area(g: str | Column) -> Column:
    """Planar area, holes taken off; lines and points have 0."""
    part = lambda rs: 2 * F.abs(signed_area(rs[0])) - _total(F.transform(rs, lambda r: F.abs(signed_area(r))))
    inner = F.transform(F.filter(_geom(g)["parts"], lambda p: F.size(p) > 0), part)
    return F.when(F.lower(_geom(g)["type"]).contains("polygon"), _total(inner)).when(_geom(g)["type"].isNotNull(), 0.0)


def _steps(ring: Column) -> Column:
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))


def length(g: str | Column) -> Column:
    """Length of lines, perimeter of polygons with their holes (open rings are closed)."""
    first = lambda r: F.concat(r, F.when(r[0] != F.element_at(r, -1), F.slice(r, 1, 1)).otherwise(F.slice(r, 1, 0)))
    closed = F.when(F.lower(_geom(g)["type"]).contains("polygon"), F.transform(rings(g), first)).otherwise(rings(g))
    return _total(F.transform(closed, lambda r: _total(_steps(r))))


def bounds(g: str | Column) -> Column:
    """struct<left, bottom, right, top>."""
    vs = vertices(g)
    xs, ys = F.transform(vs, lambda v: v["x"]), F.transform(vs, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("bottom"), F.array_max(xs).alias("right"), F.array_max(ys).alias("top"))


def envelope(g: str | Column) -> Column:
    b = bounds(g)
    return box(b["left"], b["bottom"], b["right"], b["top"])


def centroid(g: str | Column) -> Column:
    """struct<x, y>, weighted by area for polygons, by length for lines, else the mean vertex."""

    def moment(axis: str) -> Callable[[Column], Column]:
        return lambda r: _total(F.zip_with(r, _turn(r), lambda p, q: (p[axis] + q[axis]) * (p["x"] * q["y"] - q["x"] * p["y"]))) / 6

    def by_area(axis: str) -> Column:
        sums = F.flatten(F.transform(_geom(g)["parts"], lambda rs: F.transform(rs, lambda r, k: F.when(k == 0, 1.0).otherwise(-1.0) * F.signum(signed_area(r)) * moment(axis)(r))))
        return F.try_divide(_total(sums), area(g))

    def by_length(axis: str) -> Column:
        halves = lambda r: _total(F.zip_with(_steps(r), F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda p, q: (p[axis] + q[axis]) / 2), lambda s, m: s * m))
        return F.try_divide(_total(F.transform(rings(g), halves)), length(g))

    def mean(axis: str) -> Column:
        return F.try_divide(_total(F.transform(vertices(g), lambda v: v[axis])), F.size(vertices(g)))

    kind = F.lower(_geom(g)["type"])
    pick = lambda axis: F.when(kind.contains("polygon"), by_area(axis)).when(kind.contains("line"), by_length(axis)).otherwise(mean(axis))
    return F.struct(pick("x").alias("x"), pick("y").alias("y"))


def map_vertices(g: str | Column, rule: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Moves every vertex by a rule of x and y."""
    moved = F.transform(_geom(g)["parts"], lambda p: F.transform(p, lambda r: F.transform(r, lambda v: vertex(*rule(v["x"], v["y"])))))
    return F.struct(_geom(g)["type"].alias("type"), moved.alias("parts"))


def affine(g: str | Column, matrix: tuple[float, ...]) -> Column:
    """By (a, b, d, e, xoff, yoff): x' = a x + b y + xoff, y' = d x + e y + yoff."""
    a, b, d, e, xo, yo = matrix
    return map_vertices(g, lambda x, y: (a * x + b * y + xo, d * x + e * y + yo))


def _origin(g: str | Column, origin: str | tuple[float, float]) -> tuple[Column, Column]:
    if origin == "centroid":
        c = centroid(g)
        return c["x"], c["y"]
    if origin == "center":
        b = bounds(g)
        return (b["left"] + b["right"]) / 2, (b["bottom"] + b["top"]) / 2
    return F.lit(float(origin[0])), F.lit(float(origin[1]))


def translate(g: str | Column, xoff: float = 0.0, yoff: float = 0.0) -> Column:
    return affine(g, (1.0, 0.0, 0.0, 1.0, xoff, yoff))


def scale(g: str | Column, xfact: float = 1.0, yfact: float = 1.0, origin: str | tuple[float, float] = "center") -> Column:
    ox, oy = _origin(g, origin)
    return map_vertices(g, lambda x, y: (ox + (x - ox) * xfact, oy + (y - oy) * yfact))


def rotate(g: str | Column, angle: float, origin: str | tuple[float, float] = "center", radians: bool = False) -> Column:
    """Counter-clockwise."""
    t = angle if radians else math.radians(angle)
    c, s = math.cos(t), math.sin(t)
    ox, oy = _origin(g, origin)
    return map_vertices(g, lambda x, y: (ox + (x - ox) * c - (y - oy) * s, oy + (x - ox) * s + (y - oy) * c))


def skew(g: str | Column, xs: float = 0.0, ys: float = 0.0, origin: str | tuple[float, float] = "center", radians: bool = False) -> Column:
    tx, ty = (math.tan(v if radians else math.radians(v)) for v in (xs, ys))
    ox, oy = _origin(g, origin)
    return map_vertices(g, lambda x, y: (x + (y - oy) * tx, y + (x - ox) * ty))


def set_precision(g: str | Column, size: float) -> Column:
    """Vertices at multiples of a size."""
    return map_vertices(g, lambda x, y: (F.rint(x / size) * size, F.rint(y / size) * size))


def reverse(g: str | Column) -> Column:
    turned = F.transform(_geom(g)["parts"], lambda p: F.transform(p, lambda r: F.reverse(r)))
    return F.struct(_geom(g)["type"].alias("type"), turned.alias("parts"))


def exterior(g: str | Column) -> Column:
    return F.transform(_geom(g)["parts"], lambda p: p[0])


def interiors(g: str | Column) -> Column:
    return F.flatten(F.transform(_geom(g)["parts"], lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))))


def boundary(g: str | Column) -> Column:
    """Rings as lines."""
    return F.struct(F.lit("MultiLineString").alias("type"), F.transform(rings(g), lambda r: F.array(r)).alias("parts"))


def get_part(g: str | Column, index: int) -> Column:
    one = F.try_element_at(_geom(g)["parts"], F.lit(index + 1))
    return F.struct(F.regexp_replace(_geom(g)["type"], "^Multi", "").alias("type"), F.array(one).alias("parts"))


def is_empty(g: str | Column) -> Column:
    return F.coalesce(F.size(vertices(g)) <= 0, F.lit(True))


def is_closed(g: str | Column) -> Column:
    return F.forall(rings(g), lambda r: (F.size(r) > 0) & (r[0] == F.element_at(r, -1)))


def is_ccw(g: str | Column) -> Column:
    return signed_area(rings(g)[0]) > 0


def count_coordinates(g: str | Column) -> Column:
    return F.size(vertices(g))


def count_geometries(g: str | Column) -> Column:
    return F.size(_geom(g)["parts"])


def count_interior_rings(g: str | Column) -> Column:
    return F.size(rings(g)) - F.size(_geom(g)["parts"])


def unique_points(g: str | Column) -> Column:
    return F.array_distinct(vertices(g))


def drop_repeated(g: str | Column) -> Column:
    """Vertices that equal the one before go."""
    kept = F.transform(_geom(g)["parts"], lambda p: F.transform(p, lambda r: F.filter(r, lambda v, k: (k == 0) | (v != F.get(r, k - 1)))))
    return F.struct(_geom(g)["type"].alias("type"), kept.alias("parts"))


def segmentize(g: str | Column, most: float) -> Column:
    """Vertices added so that no segment is longer than ``most``, evenly within each.

    Spark can't hand this expression to a Python function in the same stage; write it out in between.
    """

    def dense(r: Column) -> Column:
        n = F.greatest(F.size(r) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(r, 1, n), F.slice(r, 2, n), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

        def fill(s: Column) -> Column:
            k = F.greatest(F.lit(1), F.ceil(F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]) / most).cast("int"))
            return F.transform(F.sequence(F.lit(0), k - 1), lambda i: vertex(s["p"]["x"] + (s["q"]["x"] - s["p"]["x"]) * i / k, s["p"]["y"] + (s["q"]["y"] - s["p"]["y"]) * i / k))

        return F.concat(F.flatten(F.transform(pairs, fill)), F.slice(r, -1, 1))

    return F.struct(_geom(g)["type"].alias("type"), F.transform(_geom(g)["parts"], lambda p: F.transform(p, dense)).alias("parts"))


def equals_exact(a: str | Column, b: str | Column, tolerance: float = 0.0) -> Column:
    va, vb = vertices(a), vertices(b)
    near = F.zip_with(va, vb, lambda p, q: (F.abs(p["x"] - q["x"]) <= tolerance) & (F.abs(p["y"] - q["y"]) <= tolerance))
    return (F.size(va) == F.size(vb)) & F.forall(near, lambda v: F.coalesce(v, F.lit(False)))


def contains_point(g: str | Column, x: Column, y: Column) -> Column:
    """Even-odd rule over the rings of each polygon."""

    def odd(r: Column) -> Column:
        cross = F.zip_with(r, _turn(r), lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.when(q["y"] == p["y"], 1.0).otherwise(q["y"] - p["y"])), 1).otherwise(0))
        return F.aggregate(cross, F.lit(0), lambda acc, v: acc + v) % 2

    return F.exists(_geom(g)["parts"], lambda p: F.aggregate(F.transform(p, odd), F.lit(0), lambda acc, v: acc + v) % 2 == 1)


def distance_to_point(g: str | Column, x: Column, y: Column) -> Column:
    """0 inside a polygon, else the distance to its edges; to the vertex for points."""

    def segment(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((x - p["x"]) * dx + (y - p["y"]) * dy, dx * dx + dy * dy))), F.lit(0.0))
        return F.hypot(x - p["x"] - t * dx, y - p["y"] - t * dy)

    def near(r: Column) -> Column:
        n = F.greatest(F.size(r) - 1, F.lit(1))
        return F.array_min(F.zip_with(F.slice(r, 1, n), F.when(F.size(r) > 1, F.slice(r, 2, n)).otherwise(r), segment))

    kind = F.lower(_geom(g)["type"])
    return F.when(kind.contains("polygon") & contains_point(g, x, y), 0.0).otherwise(F.array_min(F.transform(rings(g), near)))


def buffer_point(x: Column, y: Column, distance: float, resolution: int = 16) -> Column:
    """Regular polygon of 4 x resolution corners around a point."""
    n = 4 * resolution
    return polygon(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: vertex(x + distance * F.cos(2 * math.pi * (k % n) / n), y - distance * F.sin(2 * math.pi * (k % n) / n))))


def _number(v: Column) -> Column:
    return F.regexp_replace(v.cast("string"), r"\.0$", "")


def to_wkt(g: str | Column) -> Column:
    """Well-known text of points, lines, polygons and their collections."""
    coords = lambda r: F.array_join(F.transform(r, lambda v: F.concat_ws(" ", _number(v["x"]), _number(v["y"]))), ", ")
    ring = lambda r: F.concat(F.lit("("), coords(r), F.lit(")"))
    poly = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    g = _geom(g)
    kind, parts = F.upper(g["type"]), g["parts"]
    lines = F.array_join(F.transform(F.flatten(parts), ring), ", ")
    body = (
        F.when(kind.isin("POINT", "LINESTRING"), ring(F.flatten(F.flatten(parts))))
        .when(kind == "MULTIPOINT", ring(F.flatten(F.flatten(parts)))).when(kind == "MULTILINESTRING", F.concat(F.lit("("), lines, F.lit(")")))
        .when(kind == "POLYGON", poly(parts[0])).otherwise(F.concat(F.lit("("), F.array_join(F.transform(parts, poly), ", "), F.lit(")")))
    )
    return F.when(is_empty(g), F.concat(kind, F.lit(" EMPTY"))).otherwise(F.concat(kind, F.lit(" "), body))


def to_geojson(g: str | Column) -> Column:
    """Geometry object of GeoJSON."""
    g = _geom(g)
    pair = lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))
    nested = F.transform(g["parts"], lambda p: F.transform(p, pair))
    deep = F.when(g["type"] == "Polygon", F.to_json(nested[0])).when(g["type"] == "Point", F.to_json(nested[0][0][0])).when(g["type"] == "LineString", F.to_json(nested[0][0])).when(g["type"].isin("MultiLineString", "MultiPoint"), F.to_json(F.flatten(nested))).otherwise(F.to_json(nested))
    return F.concat(F.lit('{"type":"'), g["type"], F.lit('","coordinates":'), deep, F.lit("}"))


def force_3d(g: str | Column, z: float = 0.0) -> Column:
    """Vertices with a z; those that have one keep it."""
    g = _geom(g)
    return F.struct(g["type"].alias("type"), F.transform(g["parts"], lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), F.lit(float(z)).alias("z"))))).alias("parts"))


def force_2d(g: str | Column) -> Column:
    """Vertices without z."""
    return map_vertices(g, lambda x, y: (x, y))


def geom_type(g: str | Column) -> Column:
    return _geom(g)["type"]


def get_precision(g: str | Column) -> Column:
    """The largest power of ten (at most 1) of which all coordinates are multiples, 0 if none down to 1e-9 is."""
    values = F.flatten(F.transform(vertices(g), lambda v: F.array(v["x"], v["y"])))
    steps = F.filter(F.array(*[F.lit(10.0**-k) for k in range(10)]), lambda s: F.forall(values, lambda v: F.abs(v / s - F.rint(v / s)) < 1e-6))
    return F.when(_geom(g).isNotNull(), F.coalesce(F.array_max(steps), F.lit(0.0)))
