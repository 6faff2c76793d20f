"""Polygon kernels on numpy arrays. A shape is a list of polygons, a polygon a list of rings, a ring an (n, 2) array."""

from __future__ import annotations

import numpy as np

Shape = list[list[np.ndarray]]


def encode_rings(shape: Shape) -> bytes:
    """A shape as bytes: number of polygons, rings of each, vertices of each ring, then all coordinates."""
    sizes = [len(shape), *(len(part) for part in shape), *(len(ring) for part in shape for ring in part)]
    flat = [ring for part in shape for ring in part]
    xy = np.concatenate(flat).astype("float64").tobytes() if flat else b""
    return np.array([len(sizes), *sizes], dtype="int64").tobytes() + xy


def decode_rings(data: bytes) -> Shape:
    """Reverses :func:`encode_rings`."""
    count = int(np.frombuffer(data, "int64", 1)[0])
    sizes = np.frombuffer(data, "int64", count, 8)
    xy = np.frombuffer(data, "float64", -1, 8 * (count + 1)).reshape(-1, 2)
    shape, ring, at = [], 1 + int(sizes[0]), 0
    for rings in sizes[1 : 1 + int(sizes[0])]:
        part = []
        for _ in range(int(rings)):
            part.append(xy[at : at + int(sizes[ring])])
            at += int(sizes[ring])
            ring += 1
        shape.append(part)
    return shape


def ring_crossings(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether a ray from each point crosses the ring an odd number of times; open rings are closed."""
    ax, ay = ring[:, 0], ring[:, 1]
    bx, by = np.roll(ax, -1), np.roll(ay, -1)
    odd = np.zeros(len(x), bool)
    step = max(1, (1 << 21) // max(1, len(ring)))
    for k in range(0, len(x), step):
        px, py = x[k : k + step, None], y[k : k + step, None]
        spans = (ay[None, :] > py) != (by[None, :] > py)
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = ax[None, :] + (py - ay[None, :]) * (bx - ax)[None, :] / (by - ay)[None, :]
        odd[k : k + step] = (spans & (px < cut)).sum(axis=1) % 2 == 1
    return odd


def points_inside(x: np.ndarray, y: np.ndarray, shape: Shape) -> np.ndarray:
    """Whether each point lies in one of the polygons, outside its holes."""
    inside = np.zeros(len(x), bool)
    for part in shape:
        if not part:
            continue
        held = ring_crossings(x, y, part[0])
        for hole in part[1:]:
            held &= ~ring_crossings(x, y, hole)
        inside |= held
    return inside
