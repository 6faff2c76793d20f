"""One record per key, as of its latest delivery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], stamp: str, tie: Sequence[Column] = ()) -> DataFrame:
    """Keeps, per key, the row with the greatest ``stamp``.

    Rows with a null in a key are dropped, as they cannot be told apart. A null stamp counts as older than any.
    Ties are broken by ``tie`` (greatest first), then by the greatest remaining values, so the result does not depend on
    the order of arrival. Columns keep names and order; an empty table gives an empty table.
    """
    rest = [c for c in df.columns if c not in keys and c != stamp and df.schema[c].dataType.typeName() not in ("map", "variant")]
    newest = Window.partitionBy(*keys).orderBy(F.col(stamp).desc_nulls_last(), *[t.desc_nulls_last() for t in tie], *[F.col(f"`{c}`").desc_nulls_last() for c in rest])
    ranked = df.dropna(subset=list(keys)).withColumn("_newest", F.row_number().over(newest))
    return ranked.where("_newest = 1").drop("_newest")


def latest_value(df: DataFrame, keys: Sequence[str], value: str, stamp: str, cluster: Sequence[str] | None = None) -> DataFrame:
    """Like :func:`latest` for one numeric column of large tables: two hash aggregates behind a single shuffle.

    ``cluster`` (default: the keys) is a subset of the keys to shuffle by, so that a following aggregate by it needs no
    further shuffle. A null in a key is a key like any other. Among rows of one key and stamp the greatest value counts (NaN above all, null below all).
    ``stamp`` comes back as microseconds since 1970 in ``_at``; a null stamp counts as older than any and stays null.
    """
    stamped = df.select(*keys, F.col(value).cast("double").alias(value), F.coalesce(F.unix_micros(stamp), F.lit(-(2**63))).alias("_at"))
    tasks = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small hash tables stay in the cache
    spread = stamped.repartition(tasks, *(cluster or keys))
    return spread.groupBy(*keys, "_at").agg(F.max(value).alias(value)).groupBy(*keys).agg(F.max_by(value, "_at").alias(value), F.nullif(F.max("_at"), F.lit(-(2**63))).alias("_at"))
