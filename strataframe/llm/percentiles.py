"""Percentiles of very many numbers by cumulative frequencies.

The state of a group is its table of values and counts, values rounded to a step of twice the allowed error. States of
pieces or days combine by adding counts, and give the same percentiles as all their numbers at once.

To rank, the values of each group are cut into ranges. The counts of whole ranges, one number per group and range, are
range-sorted; running sums within the partitions plus the partitions' offsets tell at which rank each range begins, and
so which ranges hold a wanted rank. Only the rows of those are sorted and summed, each range by itself. No window holds a
whole group, so a group may hold any part of all rows and be spread over any number of ranges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.plans.running import running_sum
from strataframe.plans.workspace import store

#: Default error: the half of a step of 1/8. Steps in a range: the more ranges, the fewer rows are sorted, the more totals are kept.
ERROR, RANGE = 0.0625, 1 << 7


def rounded(value: Column, error: float = ERROR, relative: bool = False) -> Column:
    """The multiple of ``2 * error`` nearest to a number, at most ``error`` away (0: the number itself).

    ``relative``: the step is in proportion to the number (a power of two), so that the result is at most ``error`` times the
    number away; ``error`` must then be below 1.
    """
    if not error:
        return value
    if relative:
        size = F.abs(value)
        octave = F.floor(F.log2(F.greatest(size, F.lit(2.0**-1000))))
        step = F.pow(F.lit(2.0), octave + math.floor(math.log2(error)))
        return F.when(size < 2.0**-900, value).otherwise(F.rint(value / step) * step) + F.lit(0.0)
    scaled = value / (2 * error)
    whole = F.when(F.abs(scaled) < 2.0**52, F.floor(scaled + 0.5).cast("double")).otherwise(scaled)  # beyond, all doubles are whole
    return whole * (2 * error) + F.lit(0.0)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, error: float = ERROR, relative: bool = False) -> DataFrame:
    """``keys, value, n``: how often each rounded value (see :func:`rounded`) stands in each group; partial counts are made before the shuffle.

    Null, NaN and infinite values are not counted; nulls in keys form a group. ``error`` 0 keeps values as they are.
    """
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    return finite.select(*keys, rounded(F.col(value).cast("double"), error, relative).alias("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def combined(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds up the counts of finer states (pieces, days, partitions) to those of ``keys``."""
    return counts.groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def _plain(df: DataFrame, keys: Sequence[str]) -> tuple[list[Column], list[str], list[Column]]:
    """Keys without nulls for joins: their columns, the columns' names, and the expressions that bring the keys back."""
    columns, names, back = [], [], []
    for k, key in enumerate(keys):
        if not df.schema[key].nullable:
            columns.append(F.col(key).alias(f"_k{k}"))
            names.append(f"_k{k}")
            back.append(F.col(f"_k{k}").alias(key))
            continue
        kind = df.schema[key].dataType.simpleString()
        empty = F.lit("").cast(kind) if kind in ("string", "binary") else F.lit(0).cast("timestamp").cast(kind) if kind.startswith(("date", "timestamp")) else F.lit(False) if kind == "boolean" else F.lit(0).cast(kind)
        columns += [F.coalesce(F.col(key), empty).alias(f"_k{k}"), F.col(key).isNull().alias(f"_n{k}")]
        names += [f"_k{k}", f"_n{k}"]
        back.append(F.when(~F.col(f"_n{k}"), F.col(f"_k{k}")).alias(key))
    return columns, names, back


def percentiles(counts: DataFrame, keys: Sequence[str], permille: Sequence[int] = (50, 250, 500, 750, 950), error: float = ERROR, relative: bool = False) -> DataFrame:
    """``keys, n, p<permille>...``: the first value whose cumulative count reaches ``n * permille / 1000`` (0: the least).

    ``counts`` are states (:func:`value_counts`, any number of them in one table: what repeats is added up) made with
    ``error`` and ``relative``; each result is within it of the exact percentile. With ``error`` 0 or relative steps there are
    no fixed ranges, and the running sums go over all values. Keys are of simple types; groups without counted values do not appear.
    """
    columns, group, back = _plain(counts, keys)
    plain = counts.select(*columns, "value", "n")
    names = [f"p{p:03d}" for p in permille]
    ranks = [F.greatest(F.lit(1).cast("bigint"), F.floor((F.col("_total") * p + 999) / 1000).cast("bigint")) for p in permille]
    if error and not relative:
        place = F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), F.col("value") / (2 * error * RANGE)))
        plain = plain.withColumn("_range", F.floor(place))
        part = [*group, "_range"]
        each = store(plain.groupBy(*part).agg(F.sum("n").alias("_own")), "ranges")
        totals = each.groupBy(*group).agg(F.sum("_own").alias("_total"))
        starts = running_sum(each, group, ["_range"], "_own", "_start").join(totals, group).withColumn("_start", F.col("_start") - F.col("_own"))
        holds = reduce(Column.__or__, [(F.col("_start") < r) & (F.col("_start") + F.col("_own") >= r) for r in ranks])
        rows = plain.join(starts.where(holds).drop("_own").hint("shuffle_hash"), part)
        upto = F.sum("n").over(Window.partitionBy(*part).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_start")
        summed = rows.select(*group, "value", "_total", upto.alias("_upto"))
    else:
        unique = store(plain.groupBy(*group, "value").agg(F.sum("n").alias("n")), "unique")
        summed = running_sum(unique, group, ["value"], "n", "_upto").join(unique.groupBy(*group).agg(F.sum("n").alias("_total")), group)
    least = [F.min(F.when(F.col("_upto") >= r, F.col("value"))).alias(c) for r, c in zip(ranks, names, strict=True)]
    return summed.groupBy(*group).agg(F.max("_total").alias("n"), *least).select(*back, "n", *names)
