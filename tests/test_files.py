"""Round trips through files, and TIFF files of other layouts made here byte by byte."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pytest

from strataframe.operators.cloud import PointCloud
from strataframe.operators.features import Vector
from strataframe.operators.raster import Raster
from strataframe.plans.grid import Grid
from strataframe.sources.geotiff import read_geotiff, read_grid, write_geotiff
from strataframe.sources.las import read_header, read_las, write_las


@pytest.mark.parametrize(("dtype", "nodata"), [("float64", -9999.0), ("float32", None), ("uint8", 255.0), ("int16", -32768.0)])
def test_geotiff_round_trip(spark, tmp_path, dtype, nodata):
    rng = np.random.default_rng(0)
    data = rng.integers(0, 200, (2, 150, 37)).astype(float)
    data[rng.random(data.shape) < 0.1] = np.nan
    grid = Grid(30.0, 0.0, 478000.0, 0.0, -30.0, 3108140.0, 150, 37, 32645, nodata, "Area", dtype)
    raster = Raster.from_array(spark, np.where(np.isnan(data), None, data).tolist(), grid)
    path = str(tmp_path / "a.tif")
    write_geotiff(raster, path, 16)
    again = read_geotiff(spark, path)
    assert again.grid.transform == grid.transform and again.grid.crs == 32645 and again.grid.dtype == dtype and again.grid.area_or_point == "Area"
    np.testing.assert_array_equal(again.to_array(), data)
    part = read_geotiff(spark, path, [2], (20, 60, 5, 30))
    np.testing.assert_array_equal(part.to_array()[0], data[1, 20:60, 5:30])
    assert part.grid.transform == grid.part(20, 60, 5, 30).transform


def tiff(order, data, tile=None, planar=False, predictor=1, deflate=False, point=False):
    """A classic TIFF of (bands, rows, columns)."""
    bands, height, width = data.shape
    kind = data.dtype.newbyteorder(order)
    th, tw = tile or (5, width)
    parts = []
    for plane in [data[k : k + 1] for k in range(bands)] if planar else [data]:
        for r in range(0, height, th):
            for c in range(0, width, tw):
                block = plane[:, r : r + th, c : c + tw]
                if tile:
                    block = np.pad(block, ((0, 0), (0, th - block.shape[1]), (0, tw - block.shape[2])))
                block = np.moveaxis(block, 0, 2)
                if predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                raw = block.astype(kind).tobytes()
                if predictor == 3:
                    planes = np.moveaxis(np.ascontiguousarray(block.astype(block.dtype.newbyteorder(">"))).view("u1").reshape(block.shape[0], -1, block.dtype.itemsize), 2, 1)
                    flat = planes.reshape(block.shape[0], -1, block.shape[2])
                    raw = np.concatenate([flat[:, :1], np.diff(flat, axis=1)], axis=1).astype("u1").tobytes()
                parts.append(zlib.compress(raw) if deflate else raw)
    out = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    offsets = []
    for p in parts:
        offsets.append(len(out))
        out += p
    fields = [(256, 3, [width]), (257, 3, [height]), (258, 3, [kind.itemsize * 8] * bands), (259, 3, [8 if deflate else 1]), (277, 3, [bands]), (284, 3, [2 if planar else 1]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * bands)]
    fields += [(322, 3, [tw]), (323, 3, [th]), (324, 4, offsets), (325, 4, [len(p) for p in parts])] if tile else [(273, 4, offsets), (278, 3, [th]), (279, 4, [len(p) for p in parts])]
    fields += [(33550, 12, [2.0, 3.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 100.0, 200.0, 0.0]), (34735, 3, [1, 1, 0, 2, 1025, 0, 1, 2 if point else 1, 2048, 0, 1, 4326])]
    extra, head = bytearray(), bytearray(struct.pack(f"{order}H", len(fields)))
    start = len(out)
    beyond = start + 2 + 12 * len(fields) + 4
    for tag, field, values in sorted(fields):
        data_ = struct.pack(f"{order}{len(values)}{ {3: 'H', 4: 'I', 12: 'd'}[field] }", *values)
        head += struct.pack(f"{order}HHI", tag, field, len(values)) + (data_.ljust(4, b"\0") if len(data_) <= 4 else struct.pack(f"{order}I", beyond + len(extra)))
        extra += data_ if len(data_) > 4 else b""
    struct.pack_into(f"{order}I", out, 4, start)
    return bytes(out + head + b"\0\0\0\0" + extra)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("how", [{}, {"tile": (16, 16)}, {"tile": (16, 16), "planar": True, "deflate": True}, {"predictor": 2, "deflate": True}, {"predictor": 3, "deflate": True, "tile": (16, 16)}, {"point": True}])
def test_other_layouts(spark, tmp_path, order, how):
    rng = np.random.default_rng(1)
    data = rng.normal(0, 100, (3, 23, 40)).astype("float32") if how.get("predictor") == 3 else rng.integers(0, 60000, (3, 23, 40)).astype("uint16")
    path = tmp_path / "b.tif"
    path.write_bytes(tiff(order, data, **how))
    grid, _ = read_grid(str(path))
    assert grid.transform == ((2.0, 0.0, 99.0, 0.0, -3.0, 201.5) if how.get("point") else (2.0, 0.0, 100.0, 0.0, -3.0, 200.0)) and grid.crs == 4326
    np.testing.assert_array_equal(read_geotiff(spark, str(path)).to_array(), data.astype(float))


def test_what_is_no_tiff(tmp_path):
    path = tmp_path / "c.tif"
    path.write_bytes(b"no tiff at all..")
    with pytest.raises(ValueError):
        read_grid(str(path))


@pytest.mark.parametrize("point_format", [0, 1, 3])
def test_las_round_trip(spark, tmp_path, point_format):
    rng = np.random.default_rng(2)
    rows = [(k, float(x), float(y), float(z), k % 7) for k, (x, y, z) in enumerate(np.round(rng.uniform(-500, 500, (300, 3)), 3))] + [(300, None, 1.0, 1.0, 0)]
    cloud = PointCloud(spark.createDataFrame(rows, "point_id long, x double, y double, z double, classification int").coalesce(1), "z", 32645)
    path = str(tmp_path / "a.las")
    write_las(cloud, path, point_format=point_format, columns=["classification"])
    head = read_header(path)
    assert (head.points, head.crs, head.point_format) == (300, 32645, point_format) and "classification" in head.columns
    again = read_las(spark, path, ["classification"])
    got = sorted((r.x, r.y, r.z, r.classification) for r in again.df.collect())
    assert np.allclose(got, sorted(r[1:] for r in rows[:-1]), atol=1e-9)
    with pytest.raises(ValueError):
        read_las(spark, path, ["colour"])


def test_features_through_files(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    v = Vector.from_dict(spark, {"a": [1, None], "b": ["x", "y"]}, [square, {"type": "MultiLineString", "coordinates": [[[0, 0], [2, 2]], [[5, 5], [6, 6]]]}], 4326)
    v.to_parquet(str(tmp_path / "p"))
    again = Vector.from_parquet(spark, str(tmp_path / "p"))
    assert again.equal(Vector(v.df, 4326)) and not again.equal(Vector(v.df, 3857))
    v.to_feather(str(tmp_path / "f"))
    import pyarrow.feather

    assert Vector.from_arrow(spark, pyarrow.feather.read_table(str(tmp_path / "f")), crs=4326).equal(again)
    made = json.loads(json.dumps(v.to_geo_dict(show_bbox=True)))
    assert made["features"][0]["geometry"]["coordinates"] == [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]] and made["features"][1]["bbox"] == [0, 0, 6, 6]
    assert Vector.from_features(spark, made["features"], 4326).equal(again)
    assert "EPSG:4326" in v.info() and v.columns[0] == "feature_id" and not v.has_z
