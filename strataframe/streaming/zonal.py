"""Zonal statistics of points that arrive in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.operators.vector import sjoin_points


def zonal_stream(points: DataFrame, features: DataFrame, stamp: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count, sum and extremes of ``value`` per feature and time window; state is dropped once a window is too old.

    ``points`` is a streaming point table with a timestamp, ``features`` a static table. The aggregates are mergeable, so
    results of windows add up to those of longer times.
    """
    held = sjoin_points(points, features).withWatermark(stamp, late)  # the join's rows carry it from here on
    grouped = held.groupBy(F.window(stamp, width), "feature_id")
    return grouped.agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
