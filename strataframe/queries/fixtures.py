"""Rasters, points and features derived from the benchmark tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions import geometry as G
from strataframe.operators.raster import Raster
from strataframe.plans.grid import Grid
from strataframe.sources.tables import table


def f1(spark: SparkSession, folder: str) -> Raster:
    """Elements of the embeddings: a row per vector, 64 columns, an eleventh without data."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").cast("int").alias("row"), "vec_id", F.posexplode("embedding").alias("col", "v"))
    value = F.when(F.pmod(F.col("vec_id") * 7 + F.col("col") * 3, F.lit(11)) != 0, F.col("v").cast("double"))
    height = e.agg(F.max("row")).first()[0] + 1
    return Raster(e.select(F.lit(1).alias("band"), "row", "col", value.alias("value")), Grid(30.0, 0.0, 478000.0, 0.0, -30.0, 3108140.0, height, 64, 32645, -99999.0))


SQL_F1 = """f1 AS (SELECT 1 AS band, CAST(vec_id AS INT) AS row, CAST(i - 1 AS INT) AS col,
  CASE WHEN (vec_id * 7 + (i - 1) * 3) % 11 = 0 THEN NULL ELSE CAST(embedding[i] AS DOUBLE) END AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i))"""

F2_GRID = Grid(1.0, 0.0, 0.0, 0.0, -1.0, 7.0, 7, 50)


def _lines(spark: SparkSession, folder: str, value) -> Raster:
    grouped = table(spark, folder, "lineitem").groupBy("l_linenumber", "l_quantity").agg(value.alias("value"))
    return Raster(grouped.select(F.lit(1).alias("band"), (F.col("l_linenumber") - 1).cast("int").alias("row"), (F.col("l_quantity") - 1).cast("int").alias("col"), F.col("value").cast("double").alias("value")), F2_GRID)


def f2(spark: SparkSession, folder: str) -> Raster:
    """Price of the first line of each line number and quantity."""
    return _lines(spark, folder, F.min(F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))["l_extendedprice"])


SQL_F2 = """f2 AS (SELECT 1 AS band, CAST(l_linenumber - 1 AS INT) AS row, CAST(l_quantity - 1 AS INT) AS col,
  arg_min(l_extendedprice, (l_orderkey, l_partkey, l_suppkey, l_shipdate)) AS value FROM lineitem GROUP BY l_linenumber, l_quantity)"""


def f5(spark: SparkSession, folder: str) -> Raster:
    """Mean discounts on the same grid, a thirteenth without data."""
    r = _lines(spark, folder, F.round(F.avg("l_discount"), 6))
    return r.with_value(F.when((F.col("row") * 50 + F.col("col")) % 13 != 0, F.col("value")))


SQL_F5 = """f5 AS (SELECT 1 AS band, CAST(l_linenumber - 1 AS INT) AS row, CAST(l_quantity - 1 AS INT) AS col,
  CASE WHEN CAST((l_linenumber - 1) * 50 + (l_quantity - 1) AS INT) % 13 = 0 THEN NULL ELSE round(avg(l_discount), 6) END AS value FROM lineitem GROUP BY l_linenumber, l_quantity)"""


def f6(spark: SparkSession, folder: str) -> Raster:
    """Three classes on the same grid."""
    return _lines(spark, folder, F.count(F.lit(1)) % 3)


SQL_F6 = """f6 AS (SELECT 1 AS band, CAST(l_linenumber - 1 AS INT) AS row, CAST(l_quantity - 1 AS INT) AS col, CAST(count(*) % 3 AS DOUBLE) AS value FROM lineitem GROUP BY l_linenumber, l_quantity)"""


def f3(spark: SparkSession, folder: str) -> DataFrame:
    """Events as points: hours, users and values."""
    e = table(spark, folder, "events")
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)).cast("double") / 3.6e9
    return e.select(F.col("event_id").alias("point_id"), hours.alias("x"), F.pmod(F.col("user_id") * 37, F.lit(150)).cast("double").alias("y"), F.col("value").alias("z"))


SQL_F3 = """f3 AS (SELECT event_id AS point_id, (epoch_us(ts) - 1704067200000000)::DOUBLE / 3.6e9::DOUBLE AS x, ((user_id * 37) % 150)::DOUBLE AS y, value AS z FROM events)"""


def f4(spark: SparkSession, folder: str) -> DataFrame:
    """A rectangle per nation on the ground of the events."""
    n = table(spark, folder, "nation")
    k = F.col("n_nationkey")
    x, y = (k % 5).cast("double") * 144, F.floor(k / 5).cast("double") * 30
    boxes = n.select(k.cast("bigint").alias("feature_id"), F.col("n_regionkey").alias("attr"), x.alias("xmin"), y.alias("ymin"), (x + 100).alias("xmax"), (y + 20).alias("ymax"))
    return boxes.withColumn("geom", G.box(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))


SQL_F4 = """f4 AS (SELECT CAST(n_nationkey AS BIGINT) AS feature_id, n_regionkey AS attr, CAST(n_nationkey % 5 AS DOUBLE) * 144 AS xmin, CAST(floor(n_nationkey / 5) AS DOUBLE) * 30 AS ymin,
  CAST(n_nationkey % 5 AS DOUBLE) * 144 + 100 AS xmax, CAST(floor(n_nationkey / 5) AS DOUBLE) * 30 + 20 AS ymax FROM nation)"""


def f7(spark: SparkSession, folder: str) -> DataFrame:
    """Irregular points over the grid of the lines."""
    p = table(spark, folder, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("point_id"), (F.col("p_size") - 1 + (k % 10).cast("double") / 10 + 0.03).alias("x"), ((k % 7).cast("double") + (k % 4).cast("double") / 4 + 0.1).alias("y"))


SQL_F7 = """f7 AS (SELECT p_partkey AS point_id, p_size - 1 + CAST(p_partkey % 10 AS DOUBLE) / 10 + 0.03::DOUBLE AS x, CAST(p_partkey % 7 AS DOUBLE) + CAST(p_partkey % 4 AS DOUBLE) / 4 + 0.1::DOUBLE AS y FROM part)"""
