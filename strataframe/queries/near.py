"""Problem 2: points near other points, and areas that contain them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions.metrics import EARTH_RADIUS
from strataframe.operators.near import near_pairs
from strataframe.operators.records import latest
from strataframe.queries.fixtures import SQL_F3, f3
from strataframe.sources.tables import table

NUMBER = r"([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
POINT = rf"(?i)^\s*(?:SRID\s*=\s*[0-9]+\s*;)?\s*POINT\s*(?:ZM|Z|M)?\s*\(\s*{NUMBER}\s+{NUMBER}(?:\s|\))"


def located_points(points: DataFrame) -> DataFrame:
    """Current points with a place: ``id, x, y``, from the columns or, where one is missing, from the text."""
    own = "x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)"
    text = [F.regexp_extract("geometry", POINT, k).try_cast("double") for k in (1, 2)]
    read = points.select("point_id", "loaded_at", *[F.when(F.expr(own), F.col(c)).otherwise(t).alias(c) for c, t in zip("xy", text, strict=True)])
    now = latest(read, ["point_id"], "loaded_at", tie=[F.col("x").isNotNull() & F.col("y").isNotNull()])
    return now.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("point_id").alias("id"), "x", "y")


def current_areas(features: DataFrame) -> DataFrame:
    """Current polygons and multipolygons: ``id, parts``."""
    slim = features.select("feature_id", "geom", "updated_at")
    now = latest(slim, ["feature_id"], "updated_at", tie=[F.col("geom").isNotNull()])
    return now.where(F.lower(F.trim("geom.type")).isin("polygon", "multipolygon")).select(F.col("feature_id").alias("id"), F.col("geom.parts").alias("parts"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_pairs(located_points(table(spark, folder, "pointcloud_points")), 0.5, current_areas(table(spark, folder, "vector_features")))


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Number of neighbours within half a metre of each located point, and of areas that hold it."""
    points = located_points(table(spark, folder, "pointcloud_points"))
    pairs = near_pairs(points, 0.5, current_areas(table(spark, folder, "vector_features")))
    ends = pairs.select(F.expr("explode(IF(relation = 'near', array(id_a, id_b), array(id_b)))").alias("id"), (F.col("relation") == "near").alias("near"))
    counts = ends.groupBy("id").agg(F.count_if("near").alias("n_near"), F.count_if(~F.col("near")).alias("n_areas"))
    return points.select("id").join(counts, "id", "left").select(F.col("id").alias("point_id"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("n_areas", F.lit(0)).alias("n_areas"))


def near_great_circle(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of the events, spread over longitudes and latitudes, at most 130 km apart on the sphere."""
    spread = f3(spark, folder).select(F.col("point_id").alias("id"), (F.col("x") / 2 - 180).alias("x"), (F.col("y") * 1.1 - 82).alias("y"))
    return near_pairs(spread, 130_000.0, metric="great_circle").select("id_a", "id_b")


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours, "near_great_circle": near_great_circle}

_POINTS = r"""
number AS (SELECT *, regexp_extract(geometry, '(?i)^\s*(?:SRID\s*=\s*[0-9]+\s*;)?\s*POINT\s*(?:ZM|Z|M)?\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)', ['gx', 'gy']) AS g FROM pointcloud_points),
placed AS (SELECT point_id, loaded_at,
  CASE WHEN x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) THEN x ELSE TRY_CAST(g.gx AS DOUBLE) END AS x,
  CASE WHEN x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) THEN y ELSE TRY_CAST(g.gy AS DOUBLE) END AS y FROM number),
now_points AS (SELECT point_id, x, y FROM placed QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY loaded_at DESC, (x IS NOT NULL AND y IS NOT NULL) DESC, x DESC, y DESC) = 1),
p AS (SELECT point_id AS id, x, y, CAST(floor(x / 0.5) AS BIGINT) AS cx, CAST(floor(y / 0.5) AS BIGINT) AS cy FROM now_points WHERE x IS NOT NULL AND y IS NOT NULL),
shift AS (SELECT CAST(a AS BIGINT) AS dx, CAST(b AS BIGINT) AS dy FROM range(-1, 2) u(a), range(-1, 2) v(b)),
near AS (SELECT a.id AS id_a, b.id AS id_b FROM (SELECT p.*, cx + dx AS kx, cy + dy AS ky FROM p, shift) a JOIN p b ON a.kx = b.cx AND a.ky = b.cy
  WHERE a.id < b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.5),
now_features AS (SELECT feature_id, geom FROM vector_features QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY updated_at DESC, (geom IS NOT NULL) DESC) = 1),
areas AS (SELECT feature_id, geom.parts AS parts FROM now_features WHERE lower(trim(geom.type)) IN ('polygon', 'multipolygon')),
part AS (SELECT feature_id, k, parts[k] AS rings FROM areas, unnest(range(1, len(parts) + 1)) u(k)),
ring AS (SELECT feature_id, k, r, rings[r] AS vs FROM part, unnest(range(1, len(rings) + 1)) u(r)),
edge AS (SELECT feature_id, k, r, vs[i].x AS ax, vs[i].y AS ay, vs[i % len(vs) + 1].x AS bx, vs[i % len(vs) + 1].y AS by_ FROM ring, unnest(range(1, len(vs) + 1)) u(i)),
box AS (SELECT feature_id, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM edge GROUP BY feature_id),
cross_ AS (SELECT e.feature_id, e.k, e.r, p.id, count(*) FILTER ((ay > p.y) <> (by_ > p.y) AND p.x < ax + (p.y - ay) * (bx - ax) / CASE WHEN by_ = ay THEN 1 ELSE by_ - ay END) % 2 AS odd
  FROM box JOIN p ON p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1 JOIN edge e ON e.feature_id = box.feature_id GROUP BY ALL),
held AS (SELECT feature_id, k, id FROM cross_ GROUP BY ALL HAVING bool_and(CASE WHEN r = 1 THEN odd = 1 ELSE odd = 0 END)),
inside AS (SELECT DISTINCT feature_id AS id_a, id AS id_b FROM held)
"""

_SPHERE = f"""{SQL_F3}, s AS (SELECT point_id AS id, radians(x / 2 - 180) AS lon, radians(y * 1.1::DOUBLE - 82) AS lat FROM f3)"""

ORACLES = {
    "near_great_circle": f"""WITH {_SPHERE} SELECT a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.lat BETWEEN b.lat - 0.021::DOUBLE AND b.lat + 0.021::DOUBLE AND a.id < b.id
WHERE 2 * {EARTH_RADIUS}::DOUBLE * asin(sqrt(least(1, pow(sin((b.lat - a.lat) / 2), 2) + cos(a.lat) * cos(b.lat) * pow(sin((b.lon - a.lon) / 2), 2)))) <= 130000""",
    "p2_found": f"WITH {_POINTS} SELECT 'near' AS relation, id_a, id_b FROM near UNION ALL SELECT 'inside', id_a, id_b FROM inside",
    "p2_neighbours": f"""WITH {_POINTS}, ends AS (SELECT id_a AS id FROM near UNION ALL SELECT id_b FROM near), n AS (SELECT id, count(*) AS c FROM ends GROUP BY id), m AS (SELECT id_b AS id, count(*) AS c FROM inside GROUP BY 1)
SELECT p.id AS point_id, coalesce(n.c, 0) AS n_near, coalesce(m.c, 0) AS n_areas FROM p LEFT JOIN n USING (id) LEFT JOIN m USING (id)""",
}
