"""Running sums over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.plans.workspace import store


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, tasks: int | None = None) -> DataFrame:
    """Adds ``out``, the sum of ``value`` (a whole number) up to and including each row of its group in ``order``.

    Rows are range-partitioned by keys and order, so a group of any size is spread over tasks. Each task sums its own
    stretch; the totals of the stretches before it, one number per group and task, are added. ``order`` must tell the
    rows of a group apart, or the rows of a tie share the sum behind the tie. Nulls in keys form a group, a null value
    counts as 0; an empty table stays empty.
    """
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(tasks, *keys, *order).withColumn("_stretch", F.spark_partition_id())
    kept = store(ranged, "ranged")
    own = kept.groupBy(*keys, "_stretch").agg(F.sum(value).alias("_own"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.select(*[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)], F.col("_stretch").alias("_s"), F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_stretch").orderBy(*order)
    summed = kept.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    match = [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(keys)]
    match.append(F.col("_stretch") == F.col("_s"))
    joined = summed.join(starts, on=match)
    return joined.select(*[F.col(c) for c in df.columns], (F.col("_in") + F.col("_start")).alias(out))

