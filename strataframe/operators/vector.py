"""Feature tables (``feature_id``, attributes, ``geom``): joins by place, grouping and cutting."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.functions import geometry as G
from strataframe.functions import kernels as K
from strataframe.functions import overlay
from strataframe.functions.crs import metric_epsg, metric_like, transform_xy
from strataframe.functions.shapes import Shape, points_inside
from strataframe.operators.raster import Raster
from strataframe.plans.boxes import meeting
from strataframe.plans.grid import Grid, check_bounds
from strataframe.plans.workspace import store


def with_bounds(features: DataFrame) -> DataFrame:
    b = G.bounds("geom")
    return features.withColumns({"_left": b["left"], "_bottom": b["bottom"], "_right": b["right"], "_top": b["top"]})


def _box(grow: float | Column = 0.0) -> list[Column]:
    return [F.col("_left") - grow, F.col("_bottom") - grow, F.col("_right") + grow, F.col("_top") + grow]


def sjoin_points(points: DataFrame, features: DataFrame, how: str = "inner") -> DataFrame:
    """Points with the features that hold them ('inner', 'left'), or points that are held ('semi') or not ('anti').

    Both sides meet by their boxes, then by the exact test. Points are told apart by ``point_id``.
    """
    if how not in ("inner", "left", "semi", "anti"):
        raise ValueError(f"unknown join: {how!r}")
    x, y = F.col("x"), F.col("y")
    met = meeting(points if how == "inner" else points.select("point_id", "x", "y"), with_bounds(features), [x, y, x, y], _box(), points=True)
    held = met.where(G.contains_point(F.col("b.geom"), F.col("a.x"), F.col("a.y")))
    more = [F.col(f"b.`{c}`") for c in features.columns if c not in points.columns]
    if how == "inner":
        return held.select("a.*", *more)
    if how == "left":
        return points.join(held.select(F.col("a.point_id"), *more), "point_id", "left").select(*[F.col(f"`{c}`") for c in [*points.columns, *(c for c in features.columns if c not in points.columns)]])
    return points.join(held.select(F.col("a.point_id")), "point_id", f"left_{how}")


#: Predicates of joins, of the left and the right geometry.
PREDICATES = {
    "intersects": K.st_intersects, "contains": K.st_contains, "within": K.st_within, "covers": K.st_covers, "covered_by": K.st_covered_by, "touches": K.st_touches,
    "overlaps": K.st_overlaps, "crosses": K.st_crosses, "contains_properly": K.st_contains_properly, "equals": K.st_equals,
}


def sjoin(left: DataFrame, right: DataFrame, predicate: str = "intersects", how: str = "inner", distance: float | None = None) -> DataFrame:
    """Pairs of features for which a predicate holds: the left columns, then the right ones, those of equal names with ``_right``.

    'dwithin' takes a ``distance``. ``how`` is 'inner', 'left' or 'right' (all features of that side, nulls beside those
    without a partner). Null and empty geometries have no partners.
    """
    if predicate != "dwithin" and predicate not in PREDICATES:
        raise ValueError(f"unknown predicate: {predicate!r}")
    if how not in ("inner", "left", "right"):
        raise ValueError(f"unknown join: {how!r}")
    met = meeting(with_bounds(left), with_bounds(right), _box(distance or 0.0), _box())
    a, b = F.col("a.geom"), F.col("b.geom")
    good = met.where(K.st_dwithin(a, b, F.lit(float(distance))) if predicate == "dwithin" else PREDICATES[predicate](a, b))
    name = lambda c: f"{c}_right" if c in left.columns else c
    mine, others = [F.col(f"a.`{c}`").alias(c) for c in left.columns], [F.col(f"b.`{c}`").alias(name(c)) for c in right.columns]
    if how == "inner":
        return good.select(*mine, *others)
    if how == "left":
        return left.join(good.select(F.col("a.feature_id").alias("feature_id"), *others), "feature_id", "left").select(*left.columns, *map(name, right.columns))
    kept = right.select(*[F.col(c).alias(name(c)) for c in right.columns])
    return kept.join(good.select(*mine, F.col("b.feature_id").alias("feature_id_right")), "feature_id_right", "left").select(*left.columns, *map(name, right.columns))


def sjoin_nearest(left: DataFrame, right: DataFrame, max_distance: float | None = None, how: str = "inner") -> DataFrame:
    """``point_id, feature_id, distance`` of the nearest features (within ``max_distance``) of each point, all of a tie.

    Distances to boxes come first: a feature farther than the far corner of another one's box is never measured. Without
    a greatest distance, the points without a partner so far look farther and farther.
    """
    boxes = store(with_bounds(right), "boxes")
    spots = left.select("point_id", "x", "y")
    x, y = F.col("x"), F.col("y")
    found: DataFrame | None = None
    n, *extent = boxes.agg(F.count("_left"), F.min("_left"), F.min("_bottom"), F.max("_right"), F.max("_top")).first()
    if n and max_distance is None:
        ends = spots.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        sides = [max(extent[k + 2], ends[k + 2] if ends[k + 2] is not None else extent[k + 2]) - min(extent[k], ends[k] if ends[k] is not None else extent[k]) for k in (0, 1)]
        whole = 2 * math.hypot(*sides) + 1e-9
        reach = max(math.sqrt(sides[0] * sides[1] / n), whole / 1024)
    else:
        whole = reach = max_distance if max_distance is not None else 0.0
    while True:
        met = meeting(spots, boxes, [x, y, x, y], _box(reach), points=True).select("a.point_id", "a.x", "a.y", "b.feature_id", "b.geom", "b._left", "b._bottom", "b._right", "b._top")
        out = lambda v, low, high: F.greatest(F.col(low) - F.col(v), F.col(v) - F.col(high), F.lit(0.0))
        far = lambda v, low, high: F.greatest(F.abs(F.col(v) - F.col(low)), F.abs(F.col(v) - F.col(high)))
        near = met.withColumns({"_near": F.hypot(out("x", "_left", "_right"), out("y", "_bottom", "_top")), "_far": F.hypot(far("x", "_left", "_right"), far("y", "_bottom", "_top"))})
        least = Window.partitionBy("point_id")
        asked = near.where(F.col("_near") <= reach).withColumn("_most", F.min("_far").over(least)).where("_near <= _most")
        measured = asked.select("point_id", "feature_id", G.distance_to_point(F.col("geom"), x, y).alias("distance")).where(F.col("distance") <= reach)
        best = measured.withColumn("_d", F.min("distance").over(least)).where("distance = _d").drop("_d")
        if reach >= whole:
            found = best if found is None else found.unionAll(best)
            break
        best = store(best, "nearest")
        found = best if found is None else found.unionAll(best)
        spots = store(spots.join(best.select("point_id"), "point_id", "left_anti"), "spots")
        if spots.isEmpty():
            break
        reach = min(whole, 4 * reach)
    return found if how == "inner" else left.select("point_id").join(found, "point_id", "left")


def _measure(block: list[tuple[int, K.Value]]):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for fid, value in block:
                area = "polygon" in (value.kind or "").lower()
                s = overlay.segments_of(value.shape, area)
                s = np.vstack([s, *[np.hstack([r[0], r[0]]) for p in value.shape for r in p if len(r) == 1]])
                best = np.full(len(x), np.inf)
                for x0, y0, x1, y1 in s:
                    dx, dy = x1 - x0, y1 - y0
                    t = np.clip(((x - x0) * dx + (y - y0) * dy) / max(dx * dx + dy * dy, 1e-300), 0, 1)
                    np.minimum(best, np.hypot(x - x0 - t * dx, y - y0 - t * dy), out=best)
                if area:
                    best[points_inside(x, y, value.shape)] = 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), fid)), pa.array(best)], names=["point_id", "feature_id", "distance"])

    return measure


def distances(points: DataFrame, features: DataFrame, block: int = 1000) -> DataFrame:
    """``point_id, feature_id, distance`` of every point to every feature of a stated set, in blocks of features.

    Each block is a pass over the points, its shapes go to all tasks. Points without a place, and null or empty features,
    have no distances.
    """
    spots = points.select(F.col("point_id").cast("bigint").alias("point_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    shapes = features.select(F.col("feature_id").cast("bigint").alias("feature_id"), "geom").where(F.col("feature_id").isNotNull() & ~G.is_empty("geom"))
    schema, out, after = "point_id bigint, feature_id bigint, distance double", None, None
    while True:
        rows = (shapes if after is None else shapes.where(F.col("feature_id") > after)).orderBy("feature_id").limit(block).toArrow()
        part = list(zip(rows.column("feature_id").to_pylist(), K.decode(rows.column("geom")), strict=True)) if rows.num_rows else []
        if part or out is None:
            found = spots.mapInArrow(_measure(part), schema)
            out = found if out is None else out.unionAll(found)
        if len(part) < block:
            return out
        after = part[-1][0]


# --- unions

#: Geometries that one task unites at once.
UNITED = 256


def _unite(keys: list[str], rule: str):
    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, head = [], None, None

        def flush() -> pa.RecordBatch:
            made = overlay.union_all(held) if rule == "union" else overlay.intersection(*held)
            return pa.RecordBatch.from_arrays([*head, K.encode([K.polygonal(made)])], names=[*keys, "geom"])

        for batch in batches:
            rows = batch.select(keys).to_pylist()
            for k, (row, shape) in enumerate(zip(rows, K.decode(batch.column(batch.schema.get_field_index("geom"))), strict=True)):
                mine = tuple(row.values())
                if key is not None and mine != key:
                    yield flush()
                    held = []
                if mine != key:
                    key, head = mine, [batch.column(c).slice(k, 1) for c in keys]
                if shape is not None:
                    held.append(shape.shape)
                if len(held) >= UNITED:
                    held = [overlay.union_all(held) if rule == "union" else overlay.intersection(*held)]
        if key is not None:
            yield flush()

    return unite


def united(features: DataFrame, by: Sequence[str] = (), rule: str = "union") -> DataFrame:
    """``by, geom``: the union (or intersection) of all polygons of each key.

    Keys of many features are first united in parts of features near each other, in as many tasks.
    """
    keys = list(by) or ["_all"]
    slim = features.select(*[F.col(c) for c in by], "geom") if by else features.select(F.lit(0).alias("_all"), "geom")
    slim = slim.where(F.col("geom").isNotNull())
    while True:
        counts = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        most = counts.agg(F.max("_n")).first()[0] or 0
        parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / UNITED)).cast("int")
        part = F.when(parts == 1, 0).otherwise(F.pmod(F.xxhash64(F.floor(G.bounds("geom")["left"])), parts)).alias("_part")
        on = [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
        split = slim.alias("s").join(counts.alias("c"), on=on).select(*[F.col(f"s.{k}") for k in keys], F.col("s.geom").alias("geom"), "_n").select(*keys, part, "geom")
        schema = T.StructType([*split.select(*keys, "_part").schema.fields, T.StructField("geom", split.schema["geom"].dataType)])
        sorted_ = split.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part")
        slim = store(sorted_.mapInArrow(_unite([*keys, "_part"], rule), schema).select(*keys, "geom"), "united")
        if most <= UNITED or slim.groupBy(*keys).count().agg(F.max("count")).first()[0] in (None, 1):
            return slim.select(*by, "geom")


def dissolve(features: DataFrame, by: str, aggregates: Sequence = ()) -> DataFrame:
    """One row per key: the aggregates and the union of all polygons."""
    shapes = united(features, [by])
    if not aggregates:
        return shapes
    sums = features.groupBy(by).agg(*aggregates)
    return sums.alias("s").join(shapes.alias("g"), F.col(f"s.{by}").eqNullSafe(F.col(f"g.{by}")), "left").select("s.*", "g.geom")


def _subtract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (feature_id, geom, other) sorted by feature, the geometry without all others."""
    ids, shapes, now, shape, taken = [], [], None, None, []

    def less() -> None:
        nonlocal shape, taken
        if taken:
            shape = overlay.difference(shape, *taken)
            taken = []

    for batch in batches:
        for fid, own, other in zip(batch.column(0).to_pylist(), K.decode(batch.column(1)), K.decode(batch.column(2)), strict=True):
            if fid != now:
                if now is not None:
                    less()
                    ids.append(now)
                    shapes.append(K.polygonal(shape))
                now, shape = fid, own.shape
            if other is not None:
                taken.append(other.shape)
            if len(taken) >= 16:
                less()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), K.encode(shapes)], names=["feature_id", "geom"])
            ids, shapes = [], []
    if now is not None:
        less()
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), K.encode([K.polygonal(shape)])], names=["feature_id", "geom"])


def without(left: DataFrame, right: DataFrame) -> DataFrame:
    """``feature_id, geom``: the parts of left polygons that no right one covers; those covered whole are left out."""
    met = meeting(with_bounds(left), with_bounds(right), _box(), _box()).select(F.col("a.feature_id").cast("bigint").alias("feature_id"), F.col("b.geom").alias("other"))
    rows = left.select(F.col("feature_id").cast("bigint").alias("feature_id"), "geom").where("feature_id IS NOT NULL AND geom IS NOT NULL").join(met, "feature_id", "left")
    made = rows.repartition("feature_id").sortWithinPartitions("feature_id").mapInArrow(_subtract, f"feature_id bigint, geom {G.GEOMETRY}")
    return made.where(~G.is_empty("geom"))


def overlay_features(left: DataFrame, right: DataFrame, how: str = "intersection") -> DataFrame:
    """``left_id, right_id, geom`` of 'intersection', 'union', 'identity', 'difference' or 'symmetric_difference' of polygons.

    Parts that only one side covers have a null in the place of the other's id.
    """
    if how not in ("intersection", "union", "identity", "difference", "symmetric_difference"):
        raise ValueError(f"unknown overlay: {how!r}")
    parts, none = [], F.lit(None).cast("bigint")
    if how in ("intersection", "union", "identity"):
        met = meeting(with_bounds(left), with_bounds(right), _box(), _box())
        both = met.select(F.col("a.feature_id").cast("bigint").alias("left_id"), F.col("b.feature_id").cast("bigint").alias("right_id"), K.st_intersection(F.col("a.geom"), F.col("b.geom")).alias("geom"))
        parts.append(both.where(~G.is_empty("geom")))
    if how != "intersection":
        parts.append(without(left, right).select(F.col("feature_id").alias("left_id"), none.alias("right_id"), "geom"))
    if how in ("union", "symmetric_difference"):
        parts.append(without(right, left).select(none.alias("left_id"), F.col("feature_id").alias("right_id"), "geom"))
    return reduce(DataFrame.unionAll, parts)


# --- buffers


def _nearer(mine: np.ndarray, others: np.ndarray, box: tuple[float, float, float, float]) -> Shape:
    """The places of a box that are nearer to one of ``mine`` than to any of ``others``."""
    cells = []
    x0, y0, x1, y1 = box
    for v in mine:
        cell = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])
        for w in others[np.argsort(np.hypot(*(others - v).T))]:
            d = w - v
            side = (cell - (v + w) / 2) @ d
            if (side <= 0).all():
                continue
            out = []
            for p, q, sp, sq in zip(cell[:-1], cell[1:], side[:-1], side[1:], strict=True):
                if sp <= 0:
                    out.append(p)
                if (sp <= 0) != (sq <= 0):
                    out.append(p + (q - p) * sp / (sp - sq))
            cell = overlay.closed(np.array(out)) if len(out) > 2 else np.empty((0, 2))
            if not len(cell):
                break
        if len(cell) and abs(overlay.ring_area(cell)) > 0:
            cells.append([[cell]])
    return overlay.union_all(cells)


def _rings_apart(distance: float):
    def rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, near = None, None, []

        def made() -> pa.RecordBatch:
            rim = overlay.difference(overlay.buffer(own, distance), own, *near)
            if rim and near:
                mine, others = np.unique(K.all_points(own), axis=0), np.unique(np.concatenate([K.all_points(s) for s in near]), axis=0)
                spots = K.all_points(rim)
                rim = overlay.intersection(rim, _nearer(mine, others, (*spots.min(axis=0), *spots.max(axis=0))))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), K.encode([K.polygonal(rim)])], names=["feature_id", "geom"])

        for batch in batches:
            for fid, shape, other in zip(batch.column(0).to_pylist(), K.decode(batch.column(1)), K.decode(batch.column(2)), strict=True):
                if fid != now:
                    if now is not None:
                        yield made()
                    now, own, near = fid, shape.shape, []
                if other is not None:
                    near.append(other.shape)
        if now is not None:
            yield made()

    return rings


def buffer(features: DataFrame, distance: float, quad_segs: int = 16) -> DataFrame:
    """Features grown (polygons: or shrunk, by a negative distance) by a distance."""
    return features.withColumn("geom", K.st_buffer("geom", F.lit(float(distance)), F.lit(quad_segs)))


def metric_crs(features: DataFrame, crs: int) -> int:
    """The UTM or polar zone around the middle of all features."""
    left, bottom, right, top = total_bounds(features).first()
    middle = features.sparkSession.range(1).select(F.lit((left + right) / 2).alias("x"), F.lit((bottom + top) / 2).alias("y"))
    lon, lat = transform_xy(F.col("x"), F.col("y"), crs, 4326)
    return middle.select(metric_epsg(lat, lon)).first()[0]


def to_crs(features: DataFrame, source: int, target: int) -> DataFrame:
    """Vertices in another reference system."""
    if source == target:
        return features
    return features.withColumn("geom", G.map_vertices("geom", lambda x, y: transform_xy(x, y, source, target)))


def _in_metres(features: DataFrame, crs: int, rule) -> DataFrame:
    metric = crs if metric_like(crs) else metric_crs(features, crs)
    moved = store(to_crs(features, crs, metric), "metric")
    return to_crs(store(rule(moved), "grown"), metric, crs)


def buffer_metric(features: DataFrame, distance: float, crs: int, quad_segs: int = 16) -> DataFrame:
    """Buffer in metres: in the local UTM zone, whatever the features' own reference system, and back."""
    return _in_metres(features, crs, lambda f: buffer(f, distance, quad_segs))


def buffer_without_overlap(features: DataFrame, distance: float, crs: int | None = None) -> DataFrame:
    """``feature_id, geom``: of the ring of ``distance`` around all polygons, the part nearest to the vertices of each.

    Each feature only looks at those whose rings can meet its own. With ``crs`` the distance is in metres.
    """
    if crs is not None:
        return _in_metres(features, crs, lambda f: buffer_without_overlap(f, distance))
    boxes = with_bounds(features.select(F.col("feature_id").cast("bigint").alias("feature_id"), "geom").where("geom IS NOT NULL"))
    near = meeting(boxes, boxes, _box(distance), _box(distance)).where("a.feature_id <> b.feature_id").select(F.col("a.feature_id").alias("feature_id"), F.col("b.geom").alias("other"))
    rows = boxes.select("feature_id", "geom").join(near, "feature_id", "left").repartition("feature_id").sortWithinPartitions("feature_id")
    return rows.mapInArrow(_rings_apart(float(distance)), f"feature_id bigint, geom {G.GEOMETRY}")


def total_bounds(features: DataFrame) -> DataFrame:
    return with_bounds(features).agg(F.min("_left").alias("left"), F.min("_bottom").alias("bottom"), F.max("_right").alias("right"), F.max("_top").alias("top"))


def explode_parts(features: DataFrame) -> DataFrame:
    """A row per part of multi-part features."""
    rest = [c for c in features.columns if c != "geom"]
    parts = features.select(*rest, F.col("geom.type").alias("_t"), F.posexplode("geom.parts").alias("part", "_p"))
    return parts.select(*rest, "part", F.struct(F.regexp_replace("_t", "^Multi", "").alias("type"), F.array("_p").alias("parts")).alias("geom"))


def crop(features: DataFrame, bbox: object, clip: bool = False) -> DataFrame:
    """Features whose box meets the bounds; with ``clip``, convex polygons are cut at the bounds."""
    left, bottom, right, top = check_bounds(bbox)
    meets = with_bounds(features).where((F.col("_left") <= right) & (F.col("_right") >= left) & (F.col("_bottom") <= top) & (F.col("_top") >= bottom)).select(*features.columns)
    if not clip:
        return meets
    rest = [c for c in features.columns if c != "geom"]
    cut = meets.select(*rest, clip_rings("geom", left, bottom, right, top).alias("geom"))
    return cut.where(~G.is_empty("geom"))


def clip_rings(g: str, left: float, bottom: float, right: float, top: float):
    """Rings cut by the four sides of a rectangle, one after the other (Sutherland-Hodgman)."""

    def side(inside, cross):
        def cut(r):
            pairs = F.zip_with(r, F.concat(F.slice(r, -1, 1), F.slice(r, 1, F.size(r) - 1)), lambda q, p: F.struct(p.alias("p"), q.alias("q")))
            empty = F.slice(r, 1, 0)
            return F.flatten(F.transform(pairs, lambda s: F.concat(
                F.when(inside(s["p"]) != inside(s["q"]), F.array(cross(s["p"], s["q"]))).otherwise(empty),
                F.when(inside(s["q"]), F.array(s["q"])).otherwise(empty),
            )))

        return cut

    def at_x(x):
        return lambda p, q: G.vertex(F.lit(float(x)), p["y"] + (q["y"] - p["y"]) * (x - p["x"]) / (q["x"] - p["x"]))

    def at_y(y):
        return lambda p, q: G.vertex(p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]), F.lit(float(y)))

    sides = [side(lambda v: v["x"] >= left, at_x(left)), side(lambda v: v["x"] <= right, at_x(right)), side(lambda v: v["y"] >= bottom, at_y(bottom)), side(lambda v: v["y"] <= top, at_y(top))]
    col = F.col(g)
    parts = col["parts"]
    for cut_side in sides:
        parts = _cut_parts(parts, cut_side)
    return F.struct(col["type"].alias("type"), F.filter(parts, lambda p: F.size(p) > 0).alias("parts"))


def overlay_boxes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Intersections of axis-parallel boxes: ``left_id, right_id, xmin, ymin, xmax, ymax``; only those with an area."""
    names = ("xmin", "ymin", "xmax", "ymax")
    box = [F.col(n) for n in names]
    slim = lambda df: df.select("feature_id", *names)
    both = meeting(slim(left), slim(right), box, box)
    rule = lambda n: (F.greatest if n.endswith("min") else F.least)(F.col(f"a.{n}"), F.col(f"b.{n}"))
    return both.select(F.col("a.feature_id").alias("left_id"), F.col("b.feature_id").alias("right_id"), *[rule(n).alias(n) for n in names]).where("xmin < xmax AND ymin < ymax")


def _cut_parts(parts, cut):
    ring = lambda r: F.when(F.size(r) > 0, cut(r)).otherwise(r)
    return F.transform(parts, lambda p: F.filter(F.transform(p, ring), lambda r: F.size(r) > 2))


def touches_box(g: str | Column, left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """Whether a line or an outline passes through a box (its segments cut by the box's four sides)."""

    def cut(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        span = lambda start, step, low, high: (
            F.when(step > 0, (low - start) / step).when(step < 0, (high - start) / step).when((start >= low) & (start <= high), F.lit(0.0)).otherwise(F.lit(2.0)),
            F.when(step > 0, (high - start) / step).when(step < 0, (low - start) / step).when((start >= low) & (start <= high), F.lit(1.0)).otherwise(F.lit(-1.0)),
        )
        (x0, x1), (y0, y1) = span(p["x"], dx, left, right), span(p["y"], dy, bottom, top)
        return F.greatest(F.lit(0.0), x0, y0) <= F.least(F.lit(1.0), x1, y1)

    def ring(r: Column) -> Column:
        n = F.greatest(F.size(r) - 1, F.lit(1))
        return F.exists(F.zip_with(F.slice(r, 1, n), F.when(F.size(r) > 1, F.slice(r, 2, n)).otherwise(r), cut), lambda v: v)

    return F.exists(G.rings(g), ring)


def rasterize(features: DataFrame, grid: Grid, burn: str | float | None = None, out: float = 0.0, all_touched: bool = False) -> Raster:
    """Each cell gets the value of the last feature (by id) that holds its centre, else ``out``.

    ``burn`` is a number, a column, or none: the features' ids. With ``all_touched``, a cell also counts if an outline or
    a line passes through it.
    """
    value = F.col("feature_id") if burn is None else F.col(burn) if isinstance(burn, str) else F.lit(burn)
    boxes = with_bounds(features).withColumn("_v", value.cast("double"))
    # the rows and columns whose centres a box can hold
    r0, r1 = F.floor((grid.f - F.col("_top")) / abs(grid.e) - 0.5), F.ceil((grid.f - F.col("_bottom")) / abs(grid.e) - 0.5)
    c0, c1 = F.floor((F.col("_left") - grid.c) / grid.a - 0.5), F.ceil((F.col("_right") - grid.c) / grid.a - 0.5)
    if all_touched:
        r0, r1, c0, c1 = r0 - 1, r1 + 1, c0 - 1, c1 + 1
    span = lambda a, b, n: F.sequence(F.greatest(a, F.lit(0)).cast("int"), F.least(b, F.lit(n - 1)).cast("int"))
    met = boxes.where((r1 >= 0) & (r0 <= grid.height - 1) & (c1 >= 0) & (c0 <= grid.width - 1))
    cells = met.withColumn("row", F.explode(span(r0, r1, grid.height))).withColumn("col", F.explode(span(c0, c1, grid.width)))
    x, y = grid.c + (F.col("col") + 0.5) * grid.a, grid.f + (F.col("row") + 0.5) * grid.e
    inside = F.lower("geom.type").contains("polygon") & G.contains_point("geom", x, y)
    if all_touched:
        inside = inside | touches_box("geom", x - abs(grid.a) / 2, y - abs(grid.e) / 2, x + abs(grid.a) / 2, y + abs(grid.e) / 2)
    held = cells.where(inside).groupBy("row", "col").agg(F.max_by("_v", "feature_id").alias("value"))
    empty = Raster(features.sparkSession.range(1).select(F.lit(1).alias("band"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(None).cast("double").alias("value")), grid).dense().df.select("band", "row", "col")
    return Raster(empty.join(held, ["row", "col"], "left").select("band", "row", "col", F.coalesce("value", F.lit(float(out))).alias("value")), grid)


def create_mask(features: DataFrame, grid: Grid, all_touched: bool = False) -> Raster:
    """True where a feature holds the cell's centre (or touches the cell)."""
    burnt = rasterize(features, grid, 1.0, all_touched=all_touched)
    return burnt.with_value(F.col("value") == 1.0)


def vector_proximity(features: DataFrame, grid: Grid, geometry: str = "boundary", where: str = "both", unit: str = "georeferenced") -> Raster:
    """Distance of each cell of a grid to the cells that features (or their boundaries) touch.

    ``where`` is 'both', or only 'in' or 'out' of the features (0 elsewhere).
    """
    from strataframe.operators.proximity import proximity

    if where not in ("both", "in", "out"):
        raise ValueError(f"where must be 'both', 'in' or 'out', not {where!r}")
    lines = features.withColumn("geom", G.boundary("geom")) if geometry == "boundary" else features
    far = proximity(rasterize(lines, grid, 1.0, all_touched=True), [1.0], unit)
    if where == "both":
        return far
    mask = create_mask(features, grid).df.select("row", "col", F.col("value").alias("_in"))
    keep = F.col("_in") if where == "in" else ~F.col("_in")
    return Raster(far.df.join(mask, ["row", "col"]).select("band", "row", "col", F.when(keep, F.col("value")).otherwise(0.0).alias("value")), grid)
