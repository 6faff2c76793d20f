"""Distances between coordinate arrays."""

from __future__ import annotations

import numpy as np

#: Mean radius of the Earth in metres (IUGG).
EARTH_RADIUS = 6_371_008.8


def plane(ax, ay, bx, by):
    """Euclidean distance."""
    return np.hypot(ax - bx, ay - by)


def great_circle(ax, ay, bx, by):
    """Distance in metres on the mean sphere; x is the longitude and y the latitude in degrees."""
    ax, ay, bx, by = (np.radians(v) for v in (ax, ay, bx, by))
    h = np.sin((by - ay) / 2) ** 2 + np.cos(ay) * np.cos(by) * np.sin((bx - ax) / 2) ** 2
    return 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(1.0, h)))


METRICS = {"plane": plane, "great_circle": great_circle}
