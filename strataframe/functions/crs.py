"""Coordinates between WGS 84, UTM zones, Web Mercator and polar stereographic, as column expressions.

UTM by the Krueger series to the third order in n, which is exact to well below a millimetre inside a zone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS 84 ellipsoid, UTM and UPS scale and false origin, Web Mercator's radius.
A, FLATTENING, UTM_SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10_000_000.0
UPS_SCALE, UPS_FALSE = 0.994, 2_000_000.0
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
N = FLATTENING / (2 - FLATTENING)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)


def utm_zone(lat: Column, lon: Column) -> Column:
    """Zone like '45N'; a meridian between zones belongs to the lower one, except the first."""
    number = F.greatest(F.lit(1), F.least(F.lit(60), F.ceil((lon + 180) / 6))).cast("int")
    return F.concat(number.cast("string"), F.when(lat >= 0, "N").otherwise("S"))


def utm_epsg(zone: Column) -> Column:
    """EPSG code of a zone like '45N'."""
    number = F.regexp_extract(zone, "^([0-9]+)", 1).try_cast("int")
    return F.when(F.upper(zone).endswith("N"), 32600 + number).otherwise(32700 + number)


def metric_epsg(lat: Column, lon: Column) -> Column:
    """UTM zone's code, or polar stereographic beyond 80 degrees."""
    return F.when(lat > 80, 32661).when(lat < -80, 32761).otherwise(utm_epsg(utm_zone(lat, lon)))


def metric_like(code: int) -> bool:
    """Whether a reference system is a UTM or polar stereographic one."""
    return _utm(code) is not None or code in (32661, 32761)


def _utm(code: int) -> tuple[float, float] | None:
    """(central meridian in radians, false northing)."""
    for base, north in ((32600, 0.0), (32700, FALSE_NORTH)):
        if base < code <= base + 60:
            return math.radians(6 * (code - base) - 183), north
    return None


def _from_geographic(lon, lat, code: int, F=F):
    """``F`` is the library of functions: of columns, or :class:`Numbers`."""
    x, y = F.radians(lon), F.radians(lat)
    if code == 3857:
        return A * x, A * F.log(F.tan(math.pi / 4 + y / 2))
    utm = _utm(code)
    if utm:
        centre, north = utm
        t = F.sinh(F.atanh(F.sin(y)) - E * F.atanh(E * F.sin(y)))
        d = x - centre
        xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
        east = eta + sum((a * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in enumerate(ALPHA, 1)), F.lit(0.0))
        up = xi + sum((a * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in enumerate(ALPHA, 1)), F.lit(0.0))
        return FALSE_EAST + UTM_SCALE * RECTIFYING * east, north + UTM_SCALE * RECTIFYING * up
    if code in (32661, 32761):
        sign = 1.0 if code == 32661 else -1.0
        p = y * sign
        t = F.tan(math.pi / 4 - p / 2) / F.pow((1 - E * F.sin(p)) / (1 + E * F.sin(p)), F.lit(E / 2))
        rho = 2 * A * UPS_SCALE * t / math.sqrt((1 + E) ** (1 + E) * (1 - E) ** (1 - E))
        return UPS_FALSE + rho * F.sin(x), UPS_FALSE - sign * rho * F.cos(x)
    raise NotImplementedError(f"EPSG:{code}")


def _to_geographic(x, y, code: int, F=F):
    if code == 3857:
        return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)
    utm = _utm(code)
    if utm:
        centre, north = utm
        xi, eta = (y - north) / (UTM_SCALE * RECTIFYING), (x - FALSE_EAST) / (UTM_SCALE * RECTIFYING)
        xi0 = xi - sum((b * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, b in enumerate(BETA, 1)), F.lit(0.0))
        eta0 = eta - sum((b * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, b in enumerate(BETA, 1)), F.lit(0.0))
        chi = F.asin(F.sin(xi0) / F.cosh(eta0))
        lat = chi + sum((d * F.sin(2 * k * chi) for k, d in enumerate(DELTA, 1)), F.lit(0.0))
        return F.degrees(centre + F.atan2(F.sinh(eta0), F.cos(xi0))), F.degrees(lat)
    if code in (32661, 32761):
        sign = 1.0 if code == 32661 else -1.0
        dx, dy = x - UPS_FALSE, -sign * (y - UPS_FALSE)
        rho = F.hypot(dx, dy)
        t = rho * math.sqrt((1 + E) ** (1 + E) * (1 - E) ** (1 - E)) / (2 * A * UPS_SCALE)
        chi = math.pi / 2 - 2 * F.atan(t)
        lat = chi + sum((d * F.sin(2 * k * chi) for k, d in enumerate(DELTA, 1)), F.lit(0.0))
        return F.degrees(F.atan2(dx, dy)), sign * F.degrees(lat)
    raise NotImplementedError(f"EPSG:{code}")


class Numbers:
    """The functions of projections on numbers and arrays."""

    radians, degrees, sin, cos, tan, sinh, cosh, sqrt, exp, log, hypot, pow = (staticmethod(getattr(np, n)) for n in ("radians", "degrees", "sin", "cos", "tan", "sinh", "cosh", "sqrt", "exp", "log", "hypot", "power"))
    atan, atan2, atanh, asin = (staticmethod(getattr(np, n)) for n in ("arctan", "arctan2", "arctanh", "arcsin"))
    lit = staticmethod(lambda v: v)


def transform_xy(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates (x before y, longitude before latitude) in another reference system; 4326, 3857, 326zz, 327zz, 32661, 32761."""
    return _transform(x, y, source, target, F)


def _transform(x, y, source: int, target: int, library):
    if source == target:
        return x, y
    lon, lat = (x, y) if source == 4326 else _to_geographic(x, y, source, library)
    return (lon, lat) if target == 4326 else _from_geographic(lon, lat, target, library)


def transform_points(x: np.ndarray, y: np.ndarray, source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for arrays."""
    return _transform(np.asarray(x, dtype="float64"), np.asarray(y, dtype="float64"), source, target, Numbers)


def compare_proj(first: object, second: object) -> bool:
    """Whether two reference systems, as codes or text, are the same."""
    from strataframe.plans.grid import check_crs

    return check_crs(first) == check_crs(second)


def densified(ring: Sequence[tuple[float, float]], points: int) -> np.ndarray:
    """A closed ring with ``points`` more vertices evenly on each side."""
    r = np.asarray(ring, dtype="float64")
    part = np.arange(points + 1)[None, :, None] / (points + 1)
    return np.vstack([(r[:-1, None, :] + part * (r[1:] - r[:-1])[:, None, :]).reshape(-1, 2), r[-1:]])


def footprint_projected(bounds: Sequence[float], source: int, target: int, densify_points: int = 5000) -> np.ndarray:
    """The closed outline of a box in another reference system; its sides are made dense first, as they bend."""
    left, bottom, right, top = bounds
    ring = densified([(left, bottom), (right, bottom), (right, top), (left, top), (left, bottom)], densify_points)
    return np.stack(transform_points(ring[:, 0], ring[:, 1], source, target), axis=1)


def bounds_projected(bounds: Sequence[float], source: int, target: int, densify_points: int = 5000) -> tuple[float, float, float, float]:
    """The box around a box's outline in another reference system."""
    ring = footprint_projected(bounds, source, target, densify_points)
    return (*map(float, ring.min(axis=0)), *map(float, ring.max(axis=0)))


def bounds2poly(bounds: Sequence[float], source: int | None = None, target: int | None = None) -> list[tuple[float, float]]:
    """The closed ring of a box's corners, in another reference system if both are given."""
    left, bottom, right, top = bounds
    x, y = np.array([left, right, right, left, left], dtype="float64"), np.array([bottom, bottom, top, top, bottom], dtype="float64")
    if source is not None and target is not None:
        x, y = transform_points(x, y, source, target)
    return list(zip(x.tolist(), y.tolist(), strict=True))


def reproject_shape(geom: str | Column, source: int, target: int) -> Column:
    """A geometry column in another reference system, vertex by vertex."""
    from strataframe.functions.geometry import map_vertices

    return map_vertices(geom, lambda x, y: transform_xy(x, y, source, target))
