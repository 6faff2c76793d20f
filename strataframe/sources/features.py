"""Feature files of two common formats: GeoPackage (through Python's own SQLite) and shapefiles.

Both are read in ranges of features, each by one task, from a path that driver and tasks can open; the driver only reads
how many there are and what columns they have.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from strataframe.functions import kernels as K
from strataframe.functions.geometry import GEOMETRY
from strataframe.functions.overlay import closed, ring_area
from strataframe.functions.shapes import points_inside
from strataframe.operators.features import Vector
from strataframe.sources.geotiff import local

#: Features that a task reads at once.
RANGE = 1 << 16
#: Types of columns in a GeoPackage.
COLUMN_TYPES = {"INTEGER": ("bigint", pa.int64()), "INT": ("bigint", pa.int64()), "MEDIUMINT": ("bigint", pa.int64()), "SMALLINT": ("bigint", pa.int64()), "TINYINT": ("bigint", pa.int64()), "REAL": ("double", pa.float64()), "DOUBLE": ("double", pa.float64()), "FLOAT": ("double", pa.float64()), "BOOLEAN": ("bigint", pa.int64())}
#: Bytes of the box in a GeoPackage's geometry, by its kind.
BOX_BYTES = (0, 32, 48, 48, 64)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _from_package(blob: bytes | None):
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    value = K.from_wkb_bytes(blob[8 + BOX_BYTES[(blob[3] >> 1) & 7] :])
    return K.Value(value["type"], K.shape_of(value))


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> Vector:
    """A layer (default: the first) with its attributes; the primary key becomes ``feature_id``."""
    file = local(path)
    with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
        layers = db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY rowid").fetchall()
        chosen = next((x for x in layers if layer is None or x[0] == layer), None)
        if chosen is None:
            raise ValueError(f"no layer {layer!r} in {path}")
        table, geometry, system = chosen
        info = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
        least, greatest = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
        code = db.execute("SELECT organization_coordsys_id FROM gpkg_spatial_ref_sys WHERE srs_id = ? AND upper(organization) = 'EPSG'", (system,)).fetchone()
    key = next((r[1] for r in info if r[5]), None)
    columns = [(r[1], *COLUMN_TYPES.get(r[2].split("(")[0].upper(), ("string", pa.string()))) for r in info if r[1] not in (geometry, key)]
    names = {c: f"{c}_1" if c in ("feature_id", "geom") else c for c, *_ in columns}
    schema = ", ".join(["feature_id bigint", *[f"`{names[c]}` {kind}" for c, kind, _ in columns], f"geom {GEOMETRY}"])
    select = f"SELECT rowid, {', '.join(_quoted(c) for c in [*[c for c, *_ in columns], geometry])} FROM {_quoted(table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
            for batch in batches:
                for n in batch.column(0).to_pylist():
                    rows = db.execute(select, (least + n * RANGE, least + (n + 1) * RANGE - 1)).fetchall()
                    plain = [pa.array([None if r[k + 1] is None else str(r[k + 1]) if kind == pa.string() else r[k + 1] for r in rows], kind) for k, (_, _, kind) in enumerate(columns)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *plain, K.encode([_from_package(r[-1]) for r in rows])], names=["feature_id", *names.values(), "geom"])

    parts = 0 if greatest is None else (greatest - least) // RANGE + 1
    made = spark.range(0, parts, 1, max(1, min(parts, 4096))).mapInArrow(read, schema)
    return Vector(made, code[0] if code else None, path)


def write_geopackage(vector: Vector, path: str, layer: str = "features") -> None:
    """One layer of a new file; rows come to the driver a partition at a time."""
    rest = [f for f in vector.df.schema.fields if f.name not in ("geom", "feature_id")]
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "BOOLEAN", "double": "REAL", "float": "REAL"}
    crs = vector.crs or 0
    Path(local(path)).unlink(missing_ok=True)
    with sqlite3.connect(local(path)) as db:
        db.execute("PRAGMA application_id = 1196444487")
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name))")
        db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", {(f"{'EPSG' if c > 0 else 'NONE'}:{c}", c, "EPSG" if c > 0 else "NONE", c) for c in (-1, 0, 4326, crs)})
        db.execute(f"CREATE TABLE {_quoted(layer)} (fid INTEGER PRIMARY KEY, geom BLOB{''.join(f', {_quoted(f.name)} ' + kinds.get(f.dataType.simpleString(), 'TEXT') for f in rest)})")
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer, layer, crs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, crs))
        rows = vector.with_wkb().select("feature_id", "geom", *[f.name for f in rest]).toLocalIterator()
        head = struct.pack("<2sBBi", b"GP", 0, 1, crs)
        plain = lambda v: v if v is None or isinstance(v, (int, float, str)) else str(v)
        db.executemany(f"INSERT INTO {_quoted(layer)} VALUES ({', '.join('?' * (2 + len(rest)))})", ((r[0], None if r[1] is None else head + bytes(r[1]), *map(plain, r[2:])) for r in rows))


def _shape(record: bytes):
    """A geometry of a shapefile's record; further ordinates are dropped."""
    kind = struct.unpack_from("<i", record)[0] % 10
    if kind == 0:
        return None
    if kind == 1:
        return K.value_of("Point", [[np.frombuffer(record, "<f8", 2, 4).reshape(1, 2)]])
    if kind == 8:
        n = struct.unpack_from("<i", record, 36)[0]
        xy = np.frombuffer(record, "<f8", 2 * n, 40).reshape(-1, 2)
        return K.value_of("MultiPoint", [[p[None, :]] for p in xy])
    parts, n = struct.unpack_from("<ii", record, 36)
    starts = np.r_[np.frombuffer(record, "<i4", parts, 44), n]
    xy = np.frombuffer(record, "<f8", 2 * n, 44 + 4 * parts).reshape(-1, 2)
    rings = [xy[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True) if b > a]
    if kind == 3:
        return K.value_of("LineString" if len(rings) == 1 else "MultiLineString", [[r] for r in rings])
    shells, holes = [[closed(r)] for r in rings if ring_area(r) < 0], [closed(r) for r in rings if ring_area(r) >= 0]  # shells turn clockwise
    shells = shells or [[closed(r)] for r in rings]
    for hole in holes if len(shells) < len(rings) else []:
        x, y = hole[0]
        owner = next((s for s in shells if points_inside(np.array([x]), np.array([y]), [[s[0]]])[0]), shells[0])
        owner.append(hole)
    return K.polygonal(shells)


def _dbf(file: Path) -> tuple[int, int, list[tuple[str, str, int, int]]]:
    """Length of the head and of a record, and columns (name, type, start, length) of the attributes' file."""
    with file.open("rb") as f:
        head = f.read(32)
        start, size = struct.unpack_from("<HH", head, 8)
        fields, at = [], 1
        for _ in range((start - 33) // 32):
            field = f.read(32)
            if field[0] == 0x0D:
                break
            fields.append((field[:11].split(b"\0")[0].decode("latin-1"), chr(field[11]), at, field[16]))
            at += field[16]
    return start, size, fields


def read_shapefile(spark: SparkSession, path: str, crs: int | None = None, encoding: str = "utf-8") -> Vector:
    """Geometries and attributes of a shapefile (``.shp`` with its ``.shx`` and ``.dbf``), numbered in order.

    The reference system is the given one; the text of a ``.prj`` file is not read.
    """
    shp = Path(local(path))
    index, table = shp.with_suffix(".shx"), shp.with_suffix(".dbf")
    with shp.open("rb") as f:
        if struct.unpack(">i", f.read(4))[0] != 9994:
            raise ValueError(f"not a shapefile: {path}")
    count = (index.stat().st_size - 100) // 8
    start, size, fields = _dbf(table) if table.exists() else (0, 0, [])
    kinds = [("double", pa.float64()) if kind in "NF" else ("string", pa.string()) for _, kind, *_ in fields]
    names = [f"{n}_1" if n in ("feature_id", "geom") else n for n, *_ in fields]

    def value(text: bytes, kind: str):
        plain = text.decode(encoding, "replace").strip().strip("\0")
        if kind in "NF":
            try:
                return float(plain)
            except ValueError:
                return None
        return plain or None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with shp.open("rb") as shapes, index.open("rb") as places:
            attributes = table.open("rb") if fields else None
            for batch in batches:
                for n in batch.column(0).to_pylist():
                    first, last = n * RANGE, min(count, (n + 1) * RANGE)
                    places.seek(100 + 8 * first)
                    at = np.frombuffer(places.read(8 * (last - first)), ">i4").reshape(-1, 2).astype("int64") * 2
                    geoms = []
                    for offset, length in at.tolist():
                        shapes.seek(offset + 8)
                        geoms.append(_shape(shapes.read(length)))
                    rows: list[bytes] = []
                    if attributes:
                        attributes.seek(start + first * size)
                        block = attributes.read((last - first) * size)
                        rows = [block[k * size : (k + 1) * size] for k in range(last - first)]
                    columns = [pa.array([value(r[b : b + w], kind) for r in rows], t) for (_, kind, b, w), (_, t) in zip(fields, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(range(first, last), pa.int64()), *columns, K.encode(geoms)], names=["feature_id", *names, "geom"])
            if attributes:
                attributes.close()

    schema = ", ".join(["feature_id bigint", *[f"`{n}` {k}" for n, (k, _) in zip(names, kinds, strict=True)], f"geom {GEOMETRY}"])
    parts = -(-count // RANGE)
    return Vector(spark.range(0, parts, 1, max(1, min(parts, 4096))).mapInArrow(read, schema), crs, path)


def read_features(spark: SparkSession, path: str, **options) -> Vector:
    """By the file's ending: ``.gpkg``, ``.shp``, ``.geojson`` or ``.json`` (a collection in one file), or a folder of Parquet."""
    ending = Path(local(path)).suffix.lower()
    if ending == ".gpkg":
        return read_geopackage(spark, path, **options)
    if ending == ".shp":
        return read_shapefile(spark, path, **options)
    if ending in (".geojson", ".json"):
        import json

        made = Vector.from_features(spark, json.loads(Path(local(path)).read_text())["features"], options.get("crs", 4326))
        return Vector(made.df, made.crs, path)
    return Vector.from_parquet(spark, path)
