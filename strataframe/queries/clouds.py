"""Queries of the point cloud operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.operators.cloud import PointCloud
from strataframe.operators.points import grid_nearest
from strataframe.plans.grid import Grid
from strataframe.queries.fixtures import SQL_F3, SQL_F4, SQL_F7, f3, f4, f7
from strataframe.queries.rasters import r6, rounded
from strataframe.queries.vectors import _HELD

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str, *fixtures: str):
    def add(run):
        QUERIES[name] = run
        ORACLES[name] = f"WITH {', '.join(fixtures)} {sql}"
        return run

    return add


_RULES = {
    "add": (lambda a, b: a + b, "z + w"), "rsub": (lambda a, b: 10.0 - b, "10 - w"), "mul": (lambda a, b: a * b, "z * w"), "div": (lambda a, b: a / b, "z / nullif(w, 0)"),
    "floordiv": (lambda a, b: a // 7.0, "floor(z / 7.0::DOUBLE)"), "mod": (lambda a, b: -a % 7.0, "-z - 7.0::DOUBLE * floor(-z / 7.0::DOUBLE)"), "pow": (lambda a, b: b**2, "w * w"), "sqrt": (lambda a, b: a.apply("sqrt"), "sqrt(z)"),
}
for _n, (_rule, _sql) in _RULES.items():

    def _algebra(spark, d, rule=_rule):
        a = PointCloud(f3(spark, d))
        out = rule(a, a.with_data(F.pmod(F.col("point_id"), F.lit(5)).cast("double"))).df
        return rounded(out.select("point_id", F.col("z").alias("value")))

    query(f"pc_algebra_{_n}", f"SELECT point_id, {r6(_sql)} AS value FROM (SELECT *, (point_id % 5)::DOUBLE AS w FROM f3)", SQL_F3)(_algebra)


@query("pc_logic", "SELECT point_id, z > 20 AND NOT (w <= 2) AS value FROM (SELECT *, (point_id % 5)::DOUBLE AS w FROM f3)", SQL_F3)
def pc_logic(spark, d):
    a = PointCloud(f3(spark, d))
    b = a.with_data(F.pmod(F.col("point_id"), F.lit(5)).cast("double"))
    return ((a > 20.0) & ~(b <= 2.0)).df.select("point_id", F.col("z").alias("value"))


@query("mask_points", f"SELECT point_id, EXISTS (SELECT 1 FROM f4 WHERE {_HELD}) AS mask FROM f3", SQL_F3, SQL_F4)
def mask_points(spark, d):
    return PointCloud(f3(spark, d)).create_mask(f4(spark, d)).df.select("point_id", "mask")


@query("pc_mask_assign", f"SELECT point_id, CASE WHEN EXISTS (SELECT 1 FROM f4 WHERE {_HELD}) THEN 0.5::DOUBLE ELSE z END AS z FROM f3", SQL_F3, SQL_F4)
def pc_mask_assign(spark, d):
    cloud = PointCloud(f3(spark, d))
    return cloud.assign(cloud.create_mask(f4(spark, d)), 0.5).df.select("point_id", "z")


_GROUND = Grid(1.0, 0.0, 0.0, 0.0, -1.0, 7.0, 7, 50)


@query(
    "pc_grid_nearest",
    "SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, (SELECT (point_id % 97)::DOUBLE FROM f7 WHERE abs(r - (7 - y)) <= 1 AND abs(c - x) <= 1 ORDER BY round((r - (7 - y)) * (r - (7 - y)) + (c - x) * (c - x), 9), point_id LIMIT 1) AS value FROM range(7) p(r), range(50) q(c)",
    SQL_F7,
)
def pc_grid_nearest(spark, d):
    pts = f7(spark, d).withColumn("v", F.pmod("point_id", F.lit(97)))
    return grid_nearest(pts, _GROUND, "v", 1.0).df.select("row", "col", "value")
