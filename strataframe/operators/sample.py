"""Deterministic samples of cells: the least keys of a mixing function of the cell's number and a seed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.operators.raster import Raster
from strataframe.plans.running import running_sum


def splitmix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 of unsigned 64-bit numbers (fixed values: its published constants)."""
    with np.errstate(over="ignore"):
        z = x.astype("uint64") + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def sample_key(number: Column, seed: int = 0) -> Column:
    """Key of a cell's number, moved to the order of signed numbers."""

    @F.pandas_udf("bigint")
    def key(n: pd.Series) -> pd.Series:
        mixed = splitmix64(n.to_numpy().astype("uint64") ^ np.uint64(seed))
        return pd.Series((mixed ^ np.uint64(1 << 63)).view("int64"))

    return key(number)


def sample_size(subsample: float, valid: int) -> int:
    """Up to 1: a part of the valid cells; above: a number of them, at most all."""
    if subsample <= 0:
        raise ValueError("the sample must be positive")
    return int(subsample * valid) if subsample <= 1 else min(int(subsample), valid)


#: Samples up to this size come out of one task; the ranks of larger ones are found by running sums.
ONE_TASK = 100_000


def least_keys(df: DataFrame, size: int, number: str, seed: int = 0) -> DataFrame:
    """The ``size`` rows with the least keys of ``number``; the same whatever the partitions.

    A small sample is a top-k, for which each task sends its own least rows. Of a large one all rows are ranked in ranges
    of their keys, so that no task holds the whole sample.
    """
    keyed = df.withColumn("_key", sample_key(F.col(number), seed))
    if size <= ONE_TASK:
        return keyed.orderBy("_key", number).limit(size).drop("_key")
    ranked = running_sum(keyed.withColumn("_one", F.lit(1)), [], ["_key", number], "_one", "_rank")
    return ranked.where(F.col("_rank") <= size).drop("_key", "_one", "_rank")


def topk_sample(raster: Raster, size: int, seed: int = 0, band: int = 1) -> DataFrame:
    """``gid, row, col, value`` of the ``size`` valid cells with the least keys; the same whatever the partitions."""
    valid = raster.df.where((F.col("band") == band) & F.col("value").isNotNull())
    keyed = valid.select((F.col("row").cast("bigint") * raster.grid.width + F.col("col")).alias("gid"), "row", "col", "value")
    return least_keys(keyed, size, "gid", seed)
