"""Reading and writing of rasters, features and points in columnar and text formats."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions import geometry as G
from strataframe.operators.raster import Raster
from strataframe.plans.grid import Grid


def write_raster(raster: Raster, path: str, tile: int = 256) -> None:
    """Cells as Parquet, partitioned by tile row so that crops read only what they need; the grid beside them."""
    tiled = raster.df.withColumns({"tile_row": F.floor(F.col("row") / tile).cast("int"), "tile_col": F.floor(F.col("col") / tile).cast("int")})
    tiled.repartition("tile_row").sortWithinPartitions("tile_row", "tile_col", "band", "row", "col").write.mode("overwrite").partitionBy("tile_row").parquet(f"{path}/cells")
    spark = raster.df.sparkSession
    spark.createDataFrame([(json.dumps(asdict(raster.grid)), tile)], "grid string, tile int").coalesce(1).write.mode("overwrite").parquet(f"{path}/grid")


def read_raster(spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> Raster:
    """A written raster; bands and windows (row_from, row_to, col_from, col_to) are pushed down to the files."""
    meta = spark.read.parquet(f"{path}/grid").first()
    grid = Grid(**json.loads(meta.grid))
    cells = spark.read.parquet(f"{path}/cells")
    if bands:
        cells = cells.where(F.col("band").isin(bands))
    if window:
        r0, r1, c0, c1 = window
        cells = cells.where(F.col("tile_row").between(r0 // meta.tile, (r1 - 1) // meta.tile) & F.col("tile_col").between(c0 // meta.tile, (c1 - 1) // meta.tile))
    raster = Raster(cells.select("band", "row", "col", "value"), grid)
    return raster.icrop(*window) if window else raster


def features_to_geojson(features: DataFrame) -> DataFrame:
    """One GeoJSON feature per row in the column ``feature``."""
    props = F.to_json(F.struct(*[F.col(c) for c in features.columns if c not in ("geom", "feature_id")]))
    return features.select(F.concat(F.lit('{"type":"Feature","id":'), F.col("feature_id").cast("string"), F.lit(',"geometry":'), G.to_geojson("geom"), F.lit(',"properties":'), props, F.lit("}")).alias("feature"))


def features_from_geojson(lines: DataFrame, column: str = "value") -> DataFrame:
    """Features from lines of GeoJSON polygons and multipolygons: ``feature_id, properties, geom``."""
    head = F.from_json(column, "type string, id bigint, geometry struct<type: string, coordinates: string>, properties map<string, string>")
    parsed = lines.select(head.alias("f")).select("f.id", "f.properties", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    shape = lambda a: F.transform(a, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: G.vertex(v[0], v[1]))))
    one = F.from_json("c", "array<array<array<double>>>")
    many = F.from_json("c", "array<array<array<array<double>>>>")
    parts = F.when(F.col("type") == "Polygon", shape(F.array(one))).when(F.col("type") == "MultiPolygon", shape(many))
    return parsed.select(F.col("id").alias("feature_id"), "properties", F.struct("type", parts.alias("parts")).alias("geom"))


def write_csv(features: DataFrame, path: str, sep: str = ",") -> None:
    """Attributes and the geometry as well-known text."""
    flat = features.withColumn("geom", G.to_wkt("geom"))
    flat.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def read_points(spark: SparkSession, path: str, x: str = "x", y: str = "y", z: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A point table from Parquet, CSV or JSON; rows without a place are an error of the data and are left out."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path)
    found = df.withColumns({"x": F.col(x).cast("double"), "y": F.col(y).cast("double")} | ({"z": F.col(z).cast("double")} if z else {}))
    return found.where("x IS NOT NULL AND y IS NOT NULL")
