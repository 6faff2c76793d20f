"""LAS point files (not compressed), read and written with numpy alone.

The driver reads the header; tasks read ranges of points by their place in the file. Versions 1.0 to 1.4, point formats 0
to 10. Files must lie where driver and tasks can open them by path.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataframe.operators.cloud import PointCloud
from strataframe.sources.geotiff import GEOGRAPHIC, PROJECTED, local

#: Fields at the start of a point record, by its format: the older ones (0 to 5) and the newer ones (6 to 10).
OLD = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
NEW = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "<u2"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
TIME, COLOUR, NEAR = [("gps_time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], [("nir", "<u2")]
FORMATS = {0: OLD, 1: OLD + TIME, 2: OLD + COLOUR, 3: OLD + TIME + COLOUR, 4: OLD + TIME, 5: OLD + TIME + COLOUR, 6: NEW, 7: NEW + COLOUR, 8: NEW + COLOUR + NEAR, 9: NEW, 10: NEW + COLOUR + NEAR}
#: Points that a task reads at once.
RANGE = 1 << 18


@dataclass(frozen=True)
class LasHeader:
    """What a file says about its points."""

    path: str
    version: tuple[int, int]
    point_format: int
    record: int
    start: int
    points: int
    scales: tuple[float, float, float]
    offsets: tuple[float, float, float]
    bounds: tuple[float, float, float, float]
    crs: int | None

    @property
    def columns(self) -> list[str]:
        return [n for n, _ in FORMATS[self.point_format] if n not in ("X", "Y", "flags")]


def read_header(path: str) -> LasHeader:
    """Reference system, number of points, bounds and columns, without reading points."""
    with open(local(path), "rb") as f:
        head = f.read(375)
        if head[:4] != b"LASF":
            raise ValueError(f"not a LAS file: {path}")
        version = (head[24], head[25])
        size, start, records, kind, record, points = struct.unpack_from("<HIIBHI", head, 94)
        if kind & 0x80 or kind & 0x7F not in FORMATS:
            raise NotImplementedError(f"point format {kind}: compressed or unknown")
        if version >= (1, 4):
            points = struct.unpack_from("<Q", head, 247)[0] or points
        numbers = struct.unpack_from("<12d", head, 131)
        x1, x0, y1, y0 = numbers[6:10]
        crs = None
        f.seek(size)
        for _ in range(records):
            vlr = f.read(54)
            if len(vlr) < 54:
                break
            number, length = struct.unpack_from("<HH", vlr, 18)
            data = f.read(length)
            if vlr[2:18].rstrip(b"\0") == b"LASF_Projection" and number == 34735:
                keys = struct.unpack(f"<{length // 2}H", data[: length // 2 * 2])
                found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
                crs = found.get(PROJECTED) or found.get(GEOGRAPHIC)
    return LasHeader(path, version, kind, record, start, points, numbers[0:3], numbers[3:6], (x0, y0, x1, y1), crs)


def _read_ranges(head: LasHeader, columns: list[str]):
    known = FORMATS[head.point_format]
    plain = np.dtype(known)
    kind = np.dtype({"names": [n for n, _ in known], "formats": [t for _, t in known], "offsets": [plain.fields[n][1] for n, _ in known], "itemsize": head.record})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(local(head.path), "rb") as f:
            for batch in batches:
                for first in batch.column(0).to_pylist():
                    f.seek(head.start + first * RANGE * head.record)
                    n = min(RANGE, head.points - first * RANGE)
                    p = np.frombuffer(f.read(n * head.record), kind)
                    xyz = [p[a] * s + o for a, s, o in zip("XYZ", head.scales, head.offsets, strict=True)]
                    more = [pa.array(np.ascontiguousarray(p[c]).astype("float64")) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first * RANGE, first * RANGE + n)), *[pa.array(v) for v in xyz], *more], names=["point_id", "x", "y", "z", *columns])

    return read


def read_las(spark: SparkSession, path: str, columns: list[str] | None = None, data: str = "z") -> PointCloud:
    """A lazy cloud, points numbered as in the file; ``columns`` besides x, y and z (default: all of the format)."""
    head = read_header(path)
    wanted = [c for c in (columns if columns is not None else head.columns) if c != "Z"]
    unknown = set(wanted) - set(head.columns)
    if unknown:
        raise ValueError(f"no columns {sorted(unknown)} in point format {head.point_format}")
    ranges = -(-head.points // RANGE)
    schema = ", ".join(["point_id bigint", "x double", "y double", "z double", *[f"`{c}` double" for c in wanted]])
    made = spark.range(0, ranges, 1, max(1, min(ranges, 4096))).mapInArrow(_read_ranges(head, wanted), schema)
    return PointCloud(made, data, head.crs)


def write_las(cloud: PointCloud, path: str, scale: float = 0.001, point_format: int = 0, columns: list[str] | None = None) -> None:
    """One file of version 1.2 (formats 0 to 3), the data column as z and ``columns`` by their names; a partition at a time.

    Points without a place or with a null in the data column are left out.
    """
    if point_format not in (0, 1, 2, 3):
        raise ValueError("formats 0 to 3 can be written")
    kind = np.dtype(FORMATS[point_format])
    more = [c for c in columns or [] if c in kind.names]
    kept = cloud.df.select("x", "y", F.col(cloud.data).cast("double").alias("_z"), *more).where("x IS NOT NULL AND y IS NOT NULL AND _z IS NOT NULL")
    n, *ends = kept.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.min("_z"), F.max("_z")).first()
    ends = [0.0 if e is None else float(e) for e in ends]
    offsets = [math.floor(ends[k]) for k in (0, 2, 4)]
    keys = struct.pack("<8H", 1, 1, 0, 1, GEOGRAPHIC if cloud.crs == 4326 else PROJECTED, 0, 1, cloud.crs) if cloud.crs else b""
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 34735, len(keys), b"") + keys if keys else b""
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"", b"strataframe", 1, 2024, 227, 227 + len(vlr), bool(vlr), point_format, kind.itemsize, n, n, 0, 0, 0, 0)
    head += struct.pack("<12d", scale, scale, scale, *offsets, ends[1], ends[0], ends[3], ends[2], ends[5], ends[4])
    with open(local(path), "wb") as f:
        f.write(head + vlr)
        batch: list = []

        def put() -> None:
            p = np.zeros(len(batch), kind)
            for k, (axis, o) in enumerate(zip("XYZ", offsets, strict=True)):
                p[axis] = np.rint((np.array([row[k] for row in batch]) - o) / scale)
            for k, c in enumerate(more):
                p[c] = [row[3 + k] or 0 for row in batch]
            f.write(p.tobytes())
            batch.clear()

        for row in kept.toLocalIterator():
            batch.append(row)
            if len(batch) >= RANGE:
                put()
        put()
