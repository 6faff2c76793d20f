"""GeoPackages and shapefiles."""

from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from strataframe.functions import geometry as G
from strataframe.operators.features import Vector
from strataframe.sources import features as files

POLYGON = {"type": "Polygon", "coordinates": [[[0, 0], [9, 0], [9, 9], [0, 9], [0, 0]], [[2, 2], [2, 4], [4, 4], [4, 2], [2, 2]]]}
TWO = {"type": "MultiPolygon", "coordinates": [[[[20, 0], [21, 0], [21, 1], [20, 0]]], [[[30, 0], [31, 0], [31, 1], [30, 0]]]]}
LINE = {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}


def test_geopackage_round_trip(spark, tmp_path, monkeypatch):
    v = Vector.from_dict(spark, {"a": [1.5, None, 3.0], "b": ["x", "yé", None]}, [POLYGON, TWO, LINE], 32645)
    with_null = Vector(v.df.unionAll(v.df.limit(1).withColumn("feature_id", F.lit(700)).withColumn("geom", F.lit(None).cast(G.GEOMETRY))), 32645)
    path = str(tmp_path / "a.gpkg")
    files.write_geopackage(with_null, path)
    monkeypatch.setattr(files, "RANGE", 2)
    again = files.read_features(spark, path)
    assert again.equal(with_null) and again.crs == 32645 and again.name == path
    with pytest.raises(ValueError):
        files.read_geopackage(spark, path, "no such layer")
    files.write_geopackage(Vector(v.df.limit(0), None), path, "none")
    empty = files.read_geopackage(spark, path, "none")
    assert empty.df.count() == 0 and empty.crs is None


def shapefile(folder, kind, records, rows):
    shp, shx = bytearray(struct.pack(">i", 9994).ljust(100, b"\0")), bytearray(b"\0" * 100)
    for k, r in enumerate(records):
        body = struct.pack("<i", kind if r else 0) + (r or b"")
        shx += struct.pack(">ii", len(shp) // 2, len(body) // 2)
        shp += struct.pack(">ii", k + 1, len(body) // 2) + body
    dbf = struct.pack("<B3sIHH20x", 3, b"", len(rows), 32 + 64 + 1, 1 + 8 + 6)
    dbf += struct.pack("<11sc4xB15x", b"NAME", b"C", 8) + struct.pack("<11sc4xB15x", b"SIZE", b"N", 6) + b"\r"
    for name, size in rows:
        dbf += b" " + name.encode().ljust(8) + str(size).rjust(6).encode()
    for ending, data in (("shp", shp), ("shx", shx), ("dbf", dbf)):
        (folder / f"a.{ending}").write_bytes(bytes(data))
    return str(folder / "a.shp")


def parts(*rings):
    flat = [v for r in rings for v in r]
    starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
    return struct.pack("<4d", 0, 0, 0, 0) + struct.pack(f"<ii{len(rings)}i", len(rings), len(flat), *starts) + b"".join(struct.pack("<2d", *map(float, v)) for v in flat)


def test_shapefile_of_polygons(spark, tmp_path):
    shell, hole, other = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)], [(20, 0), (21, 1), (21, 0), (20, 0)]
    path = shapefile(tmp_path, 5, [parts(shell, hole, other), None, parts(other)], [("one", 1.5), ("", ""), ("été", -3)])
    v = files.read_features(spark, path, crs=4326)
    rows = v.df.select("feature_id", "NAME", "SIZE", G.geom_type("geom").alias("type"), G.area("geom").alias("area")).orderBy("feature_id").collect()
    assert [tuple(r) for r in rows] == [(0, "one", 1.5, "MultiPolygon", 77.5), (1, None, None, None, None), (2, "été", -3.0, "Polygon", 0.5)] and v.crs == 4326


def test_shapefile_of_points_and_lines(spark, tmp_path):
    path = shapefile(tmp_path, 1, [struct.pack("<2d", 3.0, 4.0)], [("p", 1)])
    assert [v["x"] for v in files.read_shapefile(spark, path).df.select(G.vertices("geom")).first()[0]] == [3.0]
    path = shapefile(tmp_path, 3, [parts([(0, 0), (3, 4)], [(9, 9), (9, 10)])], [("l", 1)])
    assert files.read_shapefile(spark, path).df.select(G.length("geom")).first()[0] == 6.0
    (tmp_path / "b.shp").write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError):
        files.read_shapefile(spark, str(tmp_path / "b.shp"))


def test_geojson_file(spark, tmp_path):
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "id": 4, "properties": {"k": "v"}, "geometry": POLYGON}]}))
    row = files.read_features(spark, str(path)).df.select("feature_id", "k", G.area("geom")).first()
    assert tuple(row) == (4, "v", 77.0)
