"""GeoTIFF files, read and written with numpy alone.

Reading: the driver reads the directory of a file (its first bytes), the tasks one strip or tile each, by its place in the
file. Uncompressed, deflate and PackBits; strips or tiles; samples side by side or in planes; horizontal and floating-point
predictors; both byte orders; classic and BigTIFF. Writing: tasks make strips of deflated rows, the driver puts them
behind each other as they come, so that no more than one partition of strips is in its memory.

Files must lie where driver and tasks can open them by path (a shared folder).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataframe.functions.values import clean
from strataframe.operators.raster import Raster
from strataframe.plans.grid import Grid, default_nodata

#: Sizes of the field types of a directory, and their codes for struct.
FIELD_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
#: Numbers of the tags that are used.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, EXTRA, FORMAT, SCALE, TIEPOINT, MATRIX, GEO_KEYS, GEO_DOUBLES, GEO_TEXT, GDAL_NODATA, GDAL_METADATA = 317, 322, 323, 324, 325, 338, 339, 33550, 33922, 34264, 34735, 34736, 34737, 42113, 42112
#: Sample formats.
KINDS = {1: "u", 2: "i", 3: "f"}
#: Geographic keys of the model, the pixel's interpretation and the reference systems' codes.
MODEL, RASTER_TYPE, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072
PARTS = "band int, row int, col int, value double"


@dataclass(frozen=True)
class Layout:
    """Where the parts of a file's first image are, and how their samples are stored."""

    path: str
    order: str
    dtype: str
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    planar: bool
    part_width: int
    part_height: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    tiled: bool

    @property
    def across(self) -> int:
        return -(-self.width // self.part_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.part_height)


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def directory(path: str) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of the first directory."""
    with open(local(path), "rb") as f:
        head = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        kind = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
        if kind not in (42, 43):
            raise ValueError(f"not a TIFF file: {path}")
        big = kind == 43
        count, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
        f.seek(struct.unpack(f"{order}{word}", head[8:16] if big else head[4:8])[0])
        n = struct.unpack(f"{order}{count}", f.read(8 if big else 2))[0]
        raw = f.read(n * entry)
        tags = {}
        for k in range(n):
            e = raw[k * entry : (k + 1) * entry]
            tag, field, number = struct.unpack(f"{order}HH{word}", e[: 12 if big else 8])
            size, code = FIELD_TYPES.get(field, (1, "s"))
            place = e[12:] if big else e[8:]
            if size * number > len(place):
                f.seek(struct.unpack(f"{order}{word}", place)[0])
                place = f.read(size * number)
            if code == "s":
                tags[tag] = (place[:number].rstrip(b"\0").decode("utf-8", "replace"),) if field == 2 else (place[:number],)
            else:
                tags[tag] = struct.unpack(f"{order}{number * len(code)}{code[0]}", place[: size * number])
    return order, tags


def layout(path: str, order: str, tags: dict[int, tuple]) -> Layout:
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    bits, kind = tags.get(BITS, (1,))[0], KINDS.get(tags.get(FORMAT, (1,))[0])
    if kind is None or bits not in (8, 16, 32, 64):
        raise NotImplementedError(f"samples of {bits} bits, format {tags.get(FORMAT)}")
    compression = tags.get(COMPRESSION, (1,))[0]
    if compression not in (1, 8, 32946, 32773):
        raise NotImplementedError(f"compression {compression}")
    tiled = TILE_WIDTH in tags
    size = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, tags.get(ROWS_PER_STRIP, (height,))[0]))
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_SIZES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_SIZES])
    return Layout(path, order, f"{order}{kind}{bits // 8}", width, height, samples, compression, tags.get(PREDICTOR, (1,))[0], tags.get(PLANAR, (1,))[0] == 2, *size, offsets, sizes, tiled)


def _geo_keys(tags: dict[int, tuple]) -> dict[int, int]:
    flat = tags.get(GEO_KEYS, ())
    return {flat[k]: flat[k + 3] for k in range(4, len(flat) - 3, 4) if flat[k + 1] == 0}


def read_grid(path: str) -> tuple[Grid, Layout]:
    """The grid of a file and the layout of its parts; without georeferences a cell is a unit."""
    order, tags = directory(path)
    made = layout(path, order, tags)
    keys = _geo_keys(tags)
    if MATRIX in tags:
        m = tags[MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif SCALE in tags and TIEPOINT in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[SCALE], tags[TIEPOINT]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        transform = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    crs = next((keys[k] for k in (PROJECTED, GEOGRAPHIC) if 0 < keys.get(k, 0) < 32767), None)
    text = tags.get(GDAL_NODATA, ("",))[0].strip()
    point = {1: "Area", 2: "Point"}.get(keys.get(RASTER_TYPE))
    if point == "Point":  # the file's tie is the middle of the cell
        a, b, c, d, e, f = transform
        transform = (a, b, c - a / 2 - b / 2, d, e, f - d / 2 - e / 2)
    tags_kept = {"driver": "GTiff", "name": path, **({"metadata": tags[GDAL_METADATA][0]} if GDAL_METADATA in tags else {})}
    return Grid(*map(float, transform), made.height, made.width, crs, float(text) if text else None, point, np.dtype(made.dtype).name, tags_kept), made


def _unpacked(data: bytes) -> bytes:
    """PackBits: a count, then so many bytes, or one to repeat."""
    out, k = bytearray(), 0
    while k < len(data):
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        elif n > 128:
            out += data[k + 1 : k + 2] * (257 - n)
            k += 2
        else:
            k += 1
    return bytes(out)


def decoded(data: bytes, at: Layout, rows: int) -> np.ndarray:
    """Samples of one part: rows, columns and samples."""
    raw = zlib.decompress(data) if at.compression in (8, 32946) else _unpacked(data) if at.compression == 32773 else data
    depth, kind = 1 if at.planar else at.samples, np.dtype(at.dtype)
    shape = (rows, at.part_width, depth)
    if at.predictor == 3:  # bytes of the floats apart, the most significant first, each less the one before
        planes = np.cumsum(np.frombuffer(raw, "u1", rows * at.part_width * depth * kind.itemsize).reshape(rows, -1, depth), axis=1, dtype="u1")
        split = planes.reshape(rows, kind.itemsize, at.part_width * depth)
        return np.ascontiguousarray(np.moveaxis(split, 1, 2)).view(kind.newbyteorder(">")).reshape(shape)
    values = np.frombuffer(raw, kind, int(np.prod(shape))).reshape(shape)
    if at.predictor == 2:
        plain = kind.newbyteorder("=")
        values = np.cumsum(values.astype(plain), axis=1, dtype=plain)
    return values


def _read_parts(at: Layout):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(local(at.path), "rb") as f:
            for batch in batches:
                for n in batch.column(0).to_pylist():
                    plane, k = divmod(n, at.across * at.down)
                    r0, c0 = (k // at.across) * at.part_height, (k % at.across) * at.part_width
                    rows = at.part_height if at.tiled else min(at.part_height, at.height - r0)  # a last strip may be short
                    if at.sizes[n] == 0:  # a part that was never written
                        continue
                    f.seek(at.offsets[n])
                    values = decoded(f.read(at.sizes[n]), at, rows)[: at.height - r0, : at.width - c0].astype("float64")
                    h, w, depth = values.shape
                    row, col, band = np.meshgrid(np.arange(r0, r0 + h, dtype="int32"), np.arange(c0, c0 + w, dtype="int32"), np.arange(plane + 1, plane + 1 + depth, dtype="int32"), indexing="ij")
                    yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (band, row, col, values)], names=["band", "row", "col", "value"])

    return read


def read_geotiff(spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> Raster:
    """A lazy raster of a file's first image; of a window (row_from, row_to, col_from, col_to) only the parts it meets are read."""
    grid, at = read_grid(path)
    per_plane = at.across * at.down
    r0, r1, c0, c1 = window or (0, at.height, 0, at.width)
    inside = [k for k in range(per_plane) if (k // at.across) * at.part_height < r1 and (k // at.across + 1) * at.part_height > r0 and (k % at.across) * at.part_width < c1 and (k % at.across + 1) * at.part_width > c0]
    planes = range(at.samples) if at.planar else range(1)
    wanted = [p * per_plane + k for p in planes if not at.planar or not bands or p + 1 in bands for k in inside]
    parts = spark.createDataFrame(pd.DataFrame({"part": wanted}), "part int").repartition(max(1, min(len(wanted), 4096)), "part")
    cells = parts.mapInArrow(_read_parts(at), PARTS)
    if bands:
        cells = cells.where(F.col("band").isin(bands))
    raster = Raster(cells.select("band", "row", "col", clean(F.col("value"), grid.nodata).alias("value")), grid)
    return raster.icrop(*window) if window else raster


def _strips(grid: Grid, bands: list[int], rows: int, dtype: np.dtype, fill: float):
    def strip(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        height = min(rows, grid.height - number * rows)
        out = np.full((height, grid.width, len(bands)), fill, dtype)
        known = pdf.dropna(subset=["value"])
        out[known.row.to_numpy() - number * rows, known.col.to_numpy(), np.searchsorted(bands, known.band.to_numpy())] = known.value.to_numpy().astype(dtype)
        return pd.DataFrame({"strip": [number], "data": [zlib.compress(out.tobytes(), 6)]})

    return strip


def write_geotiff(raster: Raster, path: str, rows_per_strip: int = 64) -> None:
    """One file of deflated strips; null cells are written as nodata (the type's default where none is set)."""
    grid, bands = raster.grid, raster.bands or [1]
    dtype = np.dtype("uint8" if grid.dtype == "bool" else grid.dtype).newbyteorder("<")
    fill = float(grid.nodata if grid.nodata is not None else default_nodata(grid.dtype))
    count = -(-grid.height // rows_per_strip)
    cells = raster.df.select("band", "row", "col", F.col("value").cast("double").alias("value"), F.floor(F.col("row") / rows_per_strip).cast("int").alias("strip"))
    made = cells.groupBy("strip").applyInPandas(_strips(grid, bands, rows_per_strip, dtype, fill), "strip int, data binary").orderBy("strip")
    empty = lambda k: zlib.compress(np.full((min(rows_per_strip, grid.height - k * rows_per_strip), grid.width, len(bands)), fill, dtype).tobytes(), 6)
    with open(local(path), "wb") as f:
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
        offsets, sizes = [], []

        def put(data: bytes) -> None:
            offsets.append(f.tell())
            sizes.append(len(data))
            f.write(data)

        for row in made.toLocalIterator():
            while len(offsets) < row.strip:
                put(empty(len(offsets)))
            put(bytes(row.data))
        while len(offsets) < count:
            put(empty(len(offsets)))
        start = f.tell()
        f.write(_directory(grid, len(bands), dtype, fill, rows_per_strip, offsets, sizes, start))
        f.seek(8)
        f.write(struct.pack("<Q", start))


def _directory(grid: Grid, bands: int, dtype: np.dtype, fill: float, rows: int, offsets: list[int], sizes: list[int], start: int) -> bytes:
    keys = [(MODEL, 2 if grid.crs == 4326 else 1), (RASTER_TYPE, 2 if grid.area_or_point == "Point" else 1)]
    if grid.crs:
        keys.append((GEOGRAPHIC if grid.crs == 4326 else PROJECTED, grid.crs))
    a, b, c, d, e, f = grid.transform
    if grid.area_or_point == "Point":
        c, f = c + a / 2 + b / 2, f + d / 2 + e / 2
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    fields: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (grid.width,)), (HEIGHT, 4, (grid.height,)), (BITS, 3, (dtype.itemsize * 8,) * bands), (COMPRESSION, 3, (8,)), (PHOTOMETRIC, 3, (1,)), (STRIP_OFFSETS, 16, tuple(offsets)), (SAMPLES, 3, (bands,)),
        (ROWS_PER_STRIP, 4, (rows,)), (STRIP_SIZES, 16, tuple(sizes)), (PLANAR, 3, (1,)), *([(EXTRA, 3, (0,) * (bands - 1))] if bands > 1 else []), (FORMAT, 3, (kind,) * bands),
        (MATRIX, 12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)), (GEO_KEYS, 3, (1, 1, 0, len(keys), *[v for k, n in keys for v in (k, 0, 1, n)])), (GDAL_NODATA, 2, (f"{fill:.17g}",)),
    ]
    head, tail, beyond = struct.pack("<Q", len(fields)), b"", start + 8 + 20 * len(fields) + 8
    for tag, field, values in sorted(fields):
        size, code = FIELD_TYPES[field]
        data = values[0].encode() + b"\0" if field == 2 else struct.pack(f"<{len(values)}{code}", *values)
        number = len(data) // size
        if len(data) > 8:
            head += struct.pack("<HHQQ", tag, field, number, beyond + len(tail))
            tail += data + b"\0" * (-len(data) % 8)
        else:
            head += struct.pack("<HHQ", tag, field, number) + data.ljust(8, b"\0")
    return head + struct.pack("<Q", 0) + tail
