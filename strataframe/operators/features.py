"""Features with their reference system: conversions, metadata and the operators of :mod:`vector` as methods."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.feather
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions import geometry as G
from strataframe.functions import kernels as K
from strataframe.functions.crs import bounds_projected, footprint_projected
from strataframe.operators import vector
from strataframe.operators.raster import Raster
from strataframe.plans.grid import Bounds, Grid, check_crs


def geojson_value(geometry: dict | None) -> dict | None:
    """A geometry value of a GeoJSON geometry; further ordinates are dropped."""
    if geometry is None:
        return None
    kind, c = geometry["type"], geometry["coordinates"]
    deep = {"Point": lambda: [[[c]]], "MultiPoint": lambda: [[[v]] for v in c], "LineString": lambda: [[c]], "MultiLineString": lambda: [[r] for r in c], "Polygon": lambda: [c], "MultiPolygon": lambda: c}[kind]()
    return {"type": kind, "parts": [[[{"x": float(v[0]), "y": float(v[1])} for v in ring] for ring in part] for part in deep]}


def geojson_geometry(value) -> dict | None:
    """The GeoJSON geometry of a geometry value."""
    if value is None:
        return None
    nested = [[[[v["x"], v["y"]] for v in ring] for ring in part] for part in value["parts"] or []]
    flat = [r for p in nested for r in p]
    kind = value["type"]
    deep = {"Point": lambda: flat[0][0] if flat else [], "MultiPoint": lambda: [r[0] for r in flat], "LineString": lambda: flat[0] if flat else [], "MultiLineString": lambda: flat, "Polygon": lambda: nested[0] if nested else []}
    return {"type": kind, "coordinates": deep.get(kind, lambda: nested)()}


@dataclass(frozen=True)
class Vector:
    """A lazy feature table: ``feature_id``, attributes and ``geom``."""

    df: DataFrame
    crs: int | None = None
    name: str | None = None

    # --- from and to other forms

    @staticmethod
    def from_features(spark: SparkSession, features: Iterable[dict], crs: int | None = None) -> Vector:
        """From GeoJSON features; properties become columns of text or numbers, ids are numbered where missing."""
        rows = list(features)
        names = sorted({n for f in rows for n in f.get("properties") or {}})
        kinds = {n: "string" if any(isinstance((f.get("properties") or {}).get(n), (str, list, dict)) for f in rows) else "double" for n in names}
        cast = lambda n, v: v if v is None else float(v) if kinds[n] == "double" else v if isinstance(v, str) else json.dumps(v)
        data = [(int(f.get("id", k)), *[cast(n, (f.get("properties") or {}).get(n)) for n in names], geojson_value(f.get("geometry"))) for k, f in enumerate(rows)]
        return Vector(spark.createDataFrame(data, ", ".join(["feature_id bigint", *[f"`{n}` {kinds[n]}" for n in names], f"geom {G.GEOMETRY}"])), crs)

    @staticmethod
    def from_dict(spark: SparkSession, data: dict[str, Sequence], geometry: Sequence[dict], crs: int | None = None) -> Vector:
        """From columns, and a sequence of GeoJSON geometries."""
        return Vector.from_features(spark, ({"id": k, "properties": {n: v[k] for n, v in data.items()}, "geometry": g} for k, g in enumerate(geometry)), crs)

    @staticmethod
    def from_arrow(spark: SparkSession, table: pa.Table, geometry: str = "geom", crs: int | None = None) -> Vector:
        """From an Arrow table whose geometry column is well-known binary; without ids, rows are numbered in order."""
        values = K.encode([None if v is None else K.from_wkb_bytes(v) for v in table.column(geometry).to_pylist()])
        rest = table.drop_columns([geometry])
        if "feature_id" not in rest.column_names:
            rest = rest.add_column(0, "feature_id", pa.array(range(len(table)), pa.int64()))
        return Vector(spark.createDataFrame(rest.append_column("geom", values)), crs)

    @staticmethod
    def from_bounds_projected(spark: SparkSession, source: Grid | Vector, crs: int | None = None, densify_points: int = 5000) -> Vector:
        """One polygon: the outline of bounds, made dense, in another reference system."""
        box = source.bounds if isinstance(source, Grid) else source.total_bounds
        target = crs or source.crs
        ring = footprint_projected(box, source.crs, target, 0 if target == source.crs else densify_points)
        return Vector(spark.createDataFrame([(0, {"type": "Polygon", "parts": [[[{"x": x, "y": y} for x, y in ring.tolist()]]]})], f"feature_id bigint, geom {G.GEOMETRY}"), target)

    def with_wkb(self, name: str = "geom") -> DataFrame:
        """The table with well-known binary in the place of geometries."""
        return self.df.withColumn(name, K.to_wkb("geom"))

    def to_arrow(self) -> pa.Table:
        return self.with_wkb().toArrow()

    def to_feather(self, path: str, compression: str | None = None) -> None:
        """One Feather file, written on the driver: for tables that fit."""
        pyarrow.feather.write_feather(self.to_arrow(), path, compression=compression or "uncompressed")

    def to_parquet(self, path: str, compression: str = "snappy") -> None:
        """Parquet with well-known binary and, in the fields' metadata, the reference system."""
        table = self.with_wkb()
        kept = table.withColumn("geom", F.col("geom").alias("geom", metadata={"encoding": "WKB", "crs": self.crs}))
        kept.write.mode("overwrite").option("compression", compression).parquet(path)

    @staticmethod
    def from_parquet(spark: SparkSession, path: str) -> Vector:
        """What :meth:`to_parquet` wrote."""
        table = spark.read.parquet(path)
        return Vector(table.withColumn("geom", K.from_wkb("geom")), table.schema["geom"].metadata.get("crs"), path)

    def iterfeatures(self, na: str = "null", show_bbox: bool = False, drop_id: bool = False) -> Iterator[dict]:
        """GeoJSON features one after the other; only a partition at a time comes to the driver.

        ``na``: null properties stay ('null') or are left out ('drop').
        """
        if na not in ("null", "drop"):
            raise ValueError("na must be 'null' or 'drop'")
        for row in self.df.toLocalIterator():
            values = row.asDict(recursive=True)
            geom, fid = values.pop("geom"), values.pop("feature_id", None)
            out = {"type": "Feature", "properties": {k: v for k, v in values.items() if na == "null" or v is not None}, "geometry": geojson_geometry(geom)}
            if not drop_id:
                out["id"] = str(fid)
            if show_bbox:
                spots = [v for p in (geom or {}).get("parts") or [] for r in p for v in r]
                out["bbox"] = [min(v["x"] for v in spots), min(v["y"] for v in spots), max(v["x"] for v in spots), max(v["y"] for v in spots)] if spots else None
            yield out

    def to_geo_dict(self, show_bbox: bool = False, drop_id: bool = False) -> dict:
        return {"type": "FeatureCollection", "features": list(self.iterfeatures("null", show_bbox, drop_id))}

    def to_postgis(self, table: str, url: str, mode: str = "errorifexists", **options: str) -> None:
        """Writes geometries as well-known binary through JDBC; its driver must be on the class path."""
        self.with_wkb().write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()

    @staticmethod
    def from_postgis(spark: SparkSession, sql: str, url: str, geometry: str = "geom", crs: int | None = None, **options: str) -> Vector:
        """Result of a query whose geometry column is well-known binary (ST_AsBinary), through JDBC."""
        table = spark.read.format("jdbc").options(url=url, query=sql, **options).load()
        return Vector(table.withColumn("geom", K.from_wkb(geometry)), crs)

    # --- metadata

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def index(self) -> DataFrame:
        return self.df.select("feature_id")

    @property
    def geometry(self) -> DataFrame:
        return self.df.select("feature_id", "geom")

    @property
    def has_z(self) -> bool:
        """Whether vertices have a z."""
        return "z" in self.df.schema["geom"].dataType["parts"].dataType.elementType.elementType.elementType.names

    @property
    def total_bounds(self) -> Bounds:
        return Bounds(*vector.total_bounds(self.df).first())

    @property
    def footprint(self) -> list[tuple[float, float]]:
        """Closed ring of the bounds, in the features' own reference system."""
        left, bottom, right, top = self.total_bounds
        return [(left, bottom), (right, bottom), (right, top), (left, top), (left, bottom)]

    def get_bounds_projected(self, crs: int, densify_points: int = 5000) -> Bounds:
        return Bounds(*bounds_projected(self.total_bounds, self.crs, crs, densify_points))

    def get_footprint_projected(self, crs: int, densify_points: int = 5000) -> list[tuple[float, float]]:
        return [tuple(p) for p in footprint_projected(self.total_bounds, self.crs, crs, densify_points).tolist()]

    def get_metric_crs(self) -> int:
        return vector.metric_crs(self.df, self.crs)

    estimate_utm_crs = get_metric_crs

    def info(self) -> str:
        lines = [f"Filename:           {self.name}", f"Coordinate system:  {f'EPSG:{self.crs}' if self.crs else None}", f"Extent:             {tuple(self.total_bounds)}", f"Number of features: {self.df.count()}", f"Attributes:         {[c for c in self.columns if c not in ('geom', 'feature_id')]}"]
        return "\n".join(lines)

    def equal(self, other: Vector) -> bool:
        """Same reference system, columns and rows, whatever their order."""
        if self.crs != other.crs or sorted(self.columns) != sorted(other.columns):
            return False
        mine, others = self.df.select(*sorted(self.columns)), other.df.select(*sorted(self.columns))
        return mine.exceptAll(others).isEmpty() and others.exceptAll(mine).isEmpty()

    # --- rows, columns and reference systems

    def query(self, expression: str) -> Vector:
        return replace(self, df=self.df.where(expression))

    def __getitem__(self, key: str | Sequence[str]) -> DataFrame:
        return self.df.select(*([key] if isinstance(key, str) else key))

    def with_column(self, name: str, value: Column) -> Vector:
        return replace(self, df=self.df.withColumn(name, value))

    def copy(self) -> Vector:
        return replace(self)

    def set_geometry(self, column: str) -> Vector:
        """Another geometry column as the active one; the old one is kept as ``geom_before``."""
        return replace(self, df=self.df.withColumnsRenamed({"geom": "geom_before", column: "geom"}))

    def rename_geometry(self, name: str) -> DataFrame:
        return self.df.withColumnRenamed("geom", name)

    def set_crs(self, crs: object, allow_override: bool = False) -> Vector:
        """States the reference system without moving anything; another one than is known must be allowed."""
        code = check_crs(crs)
        if self.crs is not None and code != self.crs and not allow_override:
            raise ValueError(f"the reference system is already EPSG:{self.crs}")
        return replace(self, crs=code)

    def reproject(self, ref: Vector | Raster | Grid | None = None, crs: object = None) -> Vector:
        """In the reference system of a reference, or in a given one; exactly one of both."""
        if (ref is None) == (crs is None):
            raise ValueError("give a reference or a reference system, and not both")
        target = check_crs(crs) if crs is not None else getattr(ref, "grid", ref).crs
        if self.crs is None or target is None:
            raise ValueError("both reference systems must be known")
        return replace(self, df=vector.to_crs(self.df, self.crs, target), crs=target)

    def to_crs(self, crs: object) -> Vector:
        return self.reproject(crs=crs)

    # --- by place

    def cx(self, bbox: object, clip: bool = False) -> Vector:
        return replace(self, df=vector.crop(self.df, bbox, clip))

    crop = cx

    def sjoin(self, other: Vector, predicate: str = "intersects", how: str = "inner", distance: float | None = None) -> DataFrame:
        return vector.sjoin(self.df, other._like(self).df, predicate, how, distance)

    def overlay(self, other: Vector, how: str = "intersection") -> DataFrame:
        return vector.overlay_features(self.df, other._like(self).df, how)

    def clip(self, mask: Vector) -> Vector:
        """Features cut by polygons, attributes kept; what lies outside is dropped."""
        whole = vector.united(mask._like(self).df).withColumn("feature_id", F.lit(0))
        met = vector.overlay_features(self.df, whole).select(F.col("left_id").alias("feature_id"), "geom")
        return replace(self, df=self.df.drop("geom").join(met, "feature_id"))

    def _like(self, other: Vector) -> Vector:
        return self if self.crs == other.crs or self.crs is None or other.crs is None else self.reproject(other)

    def _pairwise(self, other: Vector, rule) -> Vector:
        mates = other._like(self).df.select("feature_id", F.col("geom").alias("_mate"))
        return replace(self, df=self.df.join(mates, "feature_id").withColumn("geom", rule(F.col("geom"), F.col("_mate"))).drop("_mate"))

    def union(self, other: Vector) -> Vector:
        """Row by row, by ids."""
        return self._pairwise(other, K.st_union)

    def intersection(self, other: Vector) -> Vector:
        return self._pairwise(other, K.st_intersection)

    def difference(self, other: Vector) -> Vector:
        return self._pairwise(other, K.st_difference)

    def symmetric_difference(self, other: Vector) -> Vector:
        return self._pairwise(other, K.st_symmetric_difference)

    def union_all(self) -> DataFrame:
        return vector.united(self.df)

    def intersection_all(self) -> DataFrame:
        return vector.united(self.df, rule="intersection")

    def dissolve(self, by: str, aggregates: Sequence[Column] = ()) -> DataFrame:
        return vector.dissolve(self.df, by, aggregates)

    def explode(self) -> Vector:
        return replace(self, df=vector.explode_parts(self.df))

    def buffer(self, distance: float) -> Vector:
        return replace(self, df=vector.buffer(self.df, distance))

    def buffer_metric(self, distance: float) -> Vector:
        return replace(self, df=vector.buffer_metric(self.df, distance, self.crs))

    def buffer_without_overlap(self, distance: float, metric: bool = True) -> Vector:
        return replace(self, df=vector.buffer_without_overlap(self.df, distance, self.crs if metric else None))

    def rasterize(self, grid: Grid, burn: str | float | None = None, out: float = 0.0, all_touched: bool = False) -> Raster:
        return vector.rasterize(self._on(grid).df, grid, burn, out, all_touched)

    def create_mask(self, grid: Grid, all_touched: bool = False) -> Raster:
        return vector.create_mask(self._on(grid).df, grid, all_touched)

    def proximity(self, grid: Grid, geometry: str = "boundary", where: str = "both", unit: str = "georeferenced") -> Raster:
        return vector.vector_proximity(self._on(grid).df, grid, geometry, where, unit)

    def _on(self, grid: Grid) -> Vector:
        return self if self.crs is None or grid.crs is None or self.crs == grid.crs else self.reproject(grid)
