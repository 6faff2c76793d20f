"""Point clouds: ``point_id, x, y``, a data column and more; a null value is no data."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions.values import ARITHMETIC, BINARY, COMPARISON, LOGIC, apply_unary, clean
from strataframe.operators.sample import least_keys
from strataframe.operators.stats import get_stats
from strataframe.operators.vector import sjoin_points
from strataframe.plans.grid import Bounds
from strataframe.plans.running import running_sum


@dataclass(frozen=True)
class PointCloud:
    """A lazy cloud whose data column is ``data``."""

    df: DataFrame
    data: str = "z"
    crs: int | None = None

    @staticmethod
    def from_xyz(df: DataFrame, x: str, y: str, z: str, crs: int | None = None, point_id: str | None = None) -> PointCloud:
        """From columns; without ids, the points are numbered."""
        number = F.col(point_id) if point_id else F.monotonically_increasing_id()
        kept = df.select(number.alias("point_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(z).alias("z"))
        return PointCloud(kept, "z", crs)

    @staticmethod
    def from_tuples(spark: SparkSession, rows: Iterable[tuple], crs: int | None = None, data: str = "z") -> PointCloud:
        """From (x, y, value) in order."""
        numbered = [(k, float(x), float(y), None if v is None else float(v)) for k, (x, y, v) in enumerate(rows)]
        return PointCloud(spark.createDataFrame(numbered, f"point_id bigint, x double, y double, `{data}` double"), data, crs)

    @staticmethod
    def from_array(spark: SparkSession, array: np.ndarray, crs: int | None = None, data: str = "z") -> PointCloud:
        """From an array of three rows or three columns (three rows, if both are three)."""
        a = np.asarray(array, dtype="float64")
        if a.ndim != 2 or 3 not in a.shape:
            raise ValueError("the array must have three rows or three columns")
        return PointCloud.from_tuples(spark, zip(*(a if a.shape[0] == 3 else a.T).tolist(), strict=True), crs, data)

    def to_xyz(self) -> DataFrame:
        """x, y and the data column."""
        return self.df.select("x", "y", F.col(self.data).alias(self.data))

    def to_array(self) -> np.ndarray:
        """Three rows on the driver, by point ids: for clouds that fit."""
        table = self.df.orderBy("point_id").select("x", "y", F.col(self.data).cast("double").alias("v")).toArrow()
        return np.stack([np.asarray(table.column(c).to_numpy(), dtype="float64") for c in ("x", "y", "v")])

    def to_tuples(self) -> list[tuple]:
        return [tuple(v) for v in self.to_array().T.tolist()]

    @property
    def is_loaded(self) -> bool:
        """Whether the cloud is kept in memory."""
        return self.df.is_cached

    @property
    def has_z(self) -> bool:
        return "z" in self.df.columns

    def reduce(self, name: str) -> float | None:
        """A function of all valid values: sum, mean, min, max, std, var, median, ptp, prod, count or argmin and argmax (ids)."""
        x = clean(F.col(self.data))
        rules = {
            "sum": F.sum(x), "mean": F.avg(x), "min": F.min(x), "max": F.max(x), "std": F.stddev_pop(x), "var": F.var_pop(x), "median": F.median(x), "ptp": F.max(x) - F.min(x), "prod": F.product(x),
            "count": F.count(x), "argmin": F.min_by("point_id", F.struct(x, "point_id")), "argmax": F.min_by("point_id", F.struct(-x, "point_id")),
        }
        if name not in rules:
            raise ValueError(f"unknown function: {name!r}")
        return self.df.where(x.isNotNull()).agg(rules[name]).first()[0]

    def cumsum(self) -> DataFrame:
        """``point_id, value``: running sum of valid values by point ids, spread over tasks."""
        valid = self.df.select("point_id", F.coalesce(clean(F.col(self.data)), F.lit(0.0)).alias("_v"))
        return running_sum(valid, [], ["point_id"], "_v", "value").select("point_id", F.col("value").cast("double").alias("value"))

    def coords_equal(self, other: PointCloud) -> bool:
        """Same reference system, and the same places by ids."""
        if self.crs != other.crs:
            return False
        mine, others = self.df.select("point_id", "x", "y"), other.df.select("point_id", "x", "y")
        return mine.exceptAll(others).isEmpty() and others.exceptAll(mine).isEmpty()

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def is_mask(self) -> bool:
        return self.df.schema[self.data].dataType.typeName() == "boolean"

    @property
    def bounds(self) -> Bounds:
        return Bounds(*self.df.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first())

    @property
    def point_count(self) -> int:
        return self.df.count()

    def set_data_column(self, name: str) -> PointCloud:
        if name not in self.df.columns:
            raise ValueError(f"no column {name!r}")
        return replace(self, data=name)

    def with_data(self, value: Column) -> PointCloud:
        return replace(self, df=self.df.withColumn(self.data, value))

    def astype(self, kind: str) -> PointCloud:
        return self.with_data(F.col(self.data).try_cast(kind))

    def _with(self, other: PointCloud | float, rule: Callable[[Column, Column], Column], swap: bool = False, tidy: bool = True) -> PointCloud:
        """By point ids; a point that lies elsewhere in the other cloud is an error when the result is computed."""
        if isinstance(other, PointCloud):
            right = other.df.select("point_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col(other.data).alias("_b"))
            df = self.df.join(right, "point_id")
            same = (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))
            b = F.when(same, F.col("_b")).otherwise(F.raise_error(F.lit("points of both clouds differ")).cast(other.df.schema[other.data].dataType))
        else:
            df, b = self.df, F.lit(other)
        a = F.col(self.data)
        value = rule(b, a) if swap else rule(a, b)
        return replace(self, df=df.withColumn(self.data, clean(value) if tidy else value).select(*self.df.columns))

    def __add__(self, other): return self._with(other, ARITHMETIC["add"])  # noqa: E704
    def __radd__(self, other): return self._with(other, ARITHMETIC["add"], True)  # noqa: E704
    def __sub__(self, other): return self._with(other, ARITHMETIC["sub"])  # noqa: E704
    def __rsub__(self, other): return self._with(other, ARITHMETIC["sub"], True)  # noqa: E704
    def __mul__(self, other): return self._with(other, ARITHMETIC["mul"])  # noqa: E704
    def __rmul__(self, other): return self._with(other, ARITHMETIC["mul"], True)  # noqa: E704
    def __truediv__(self, other): return self._with(other, ARITHMETIC["div"])  # noqa: E704
    def __rtruediv__(self, other): return self._with(other, ARITHMETIC["div"], True)  # noqa: E704
    def __floordiv__(self, other): return self._with(other, ARITHMETIC["floordiv"])  # noqa: E704
    def __rfloordiv__(self, other): return self._with(other, ARITHMETIC["floordiv"], True)  # noqa: E704
    def __mod__(self, other): return self._with(other, ARITHMETIC["mod"])  # noqa: E704
    def __pow__(self, other): return self._with(other, ARITHMETIC["pow"])  # noqa: E704
    def __neg__(self): return self.with_data(-F.col(self.data))  # noqa: E704
    def __invert__(self): return self.with_data(~F.col(self.data))  # noqa: E704
    def __and__(self, other): return self._with(other, LOGIC["and"], tidy=False)  # noqa: E704
    def __or__(self, other): return self._with(other, LOGIC["or"], tidy=False)  # noqa: E704
    def __xor__(self, other): return self._with(other, LOGIC["xor"], tidy=False)  # noqa: E704
    __rand__, __ror__, __rxor__ = __and__, __or__, __xor__

    def compare(self, name: str, other: PointCloud | float) -> PointCloud:
        return self._with(other, COMPARISON[name], tidy=False)

    def __lt__(self, other): return self.compare("lt", other)  # noqa: E704
    def __le__(self, other): return self.compare("le", other)  # noqa: E704
    def __gt__(self, other): return self.compare("gt", other)  # noqa: E704
    def __ge__(self, other): return self.compare("ge", other)  # noqa: E704

    def apply(self, name: str, other: PointCloud | float | None = None) -> PointCloud:
        return self.with_data(apply_unary(name, F.col(self.data))) if other is None else self._with(other, {**ARITHMETIC, **BINARY}[name])

    def select(self, mask: PointCloud) -> PointCloud:
        """Points where a mask holds."""
        return replace(self, df=self.df.join(mask.df.where(F.col(mask.data)).select("point_id"), "point_id", "left_semi"))

    def assign(self, mask: PointCloud, value: float | None) -> PointCloud:
        held = mask.df.select("point_id", F.col(mask.data).alias("_m"))
        marked = self.df.join(held, "point_id", "left").withColumn(self.data, F.when(F.col("_m"), F.lit(value).cast("double")).otherwise(F.col(self.data)))
        return replace(self, df=marked.select(*self.df.columns))

    def create_mask(self, features: DataFrame) -> PointCloud:
        """True for points that a feature holds."""
        held = sjoin_points(self.df.select("point_id", "x", "y"), features, "semi").select("point_id", F.lit(True).alias("_in"))
        mask = self.df.join(held, "point_id", "left").select("point_id", "x", "y", F.coalesce("_in", F.lit(False)).alias("mask"))
        return PointCloud(mask, "mask", self.crs)

    def stats(self, names: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
        return get_stats(self.df, self.data, names, by)

    def subsample(self, size: int, seed: int = 0) -> DataFrame:
        """The valid points with the least keys of their ids: the same whatever the partitions."""
        valid = self.df.where(clean(F.col(self.data)).isNotNull())
        return least_keys(valid, size, "point_id", seed)

    def equal(self, other: PointCloud) -> bool:
        """Same points, columns and data column."""
        if (self.data, self.crs, sorted(self.columns)) != (other.data, other.crs, sorted(other.columns)):
            return False
        mine, others = self.df.select(*sorted(self.columns)), other.df.select(*sorted(self.columns))
        return mine.exceptAll(others).isEmpty() and others.exceptAll(mine).isEmpty()
