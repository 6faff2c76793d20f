"""Joins of boxes that meet, on lattices whose cells are as large as the boxes.

A box belongs to the level whose cells (sides 2**level) are just larger than it, so it meets at most four of them. Two
boxes meet on the larger one's level: each is sent to its own level and to all larger ones that the other side has. A pair
is kept in the cell that holds the lower left corner of what both share, so it comes once. No cell size has to be chosen,
and a large box is not copied over the cells of small ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels beyond these are cut (sides of 2**-60 and 2**60 units).
LOWEST, HIGHEST = -60, 60


def _level(box: Sequence[Column], least: int) -> Column:
    left, bottom, right, top = box
    side = F.greatest(right - left, top - bottom)
    return F.greatest(F.lit(least), F.least(F.lit(HIGHEST), F.when(side > 2.0**LOWEST, F.ceil(F.log2(side))).otherwise(least))).cast("int")


def _levels(df: DataFrame, box: Sequence[Column]) -> list[int]:
    """The levels with boxes that have a side; a hundred at most."""
    left, bottom, right, top = box
    sized = df.where(F.greatest(right - left, top - bottom) > 0).select(_level(box, LOWEST).alias("level")).distinct()
    return sorted(r.level for r in sized.collect())


def _sent(df: DataFrame, box: Sequence[Column], others: Sequence[int], least: int, name: str) -> DataFrame:
    left, bottom, right, top = box
    own = _level(box, least).alias("own")
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), *[c.cast("double").alias(f"_{k}") for k, c in enumerate((left, bottom, right, top))], own)
    row = row.where("_0 <= _2 AND _1 <= _3")  # drops nulls and NaN, too
    at = F.explode(F.array_distinct(F.concat(F.array("own"), F.filter(F.array(*[F.lit(v) for v in others]).cast("array<int>"), lambda v: v > F.col("own")))))
    every = row.select("*", at.alias("level"))
    side = F.pow(F.lit(2.0), F.col("level"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side), F.floor(F.col(b) / side)))
    cells = every.select("*", span("_0", "_2").alias("cx")).select("*", span("_1", "_3").alias("cy"))
    return cells.select(name, F.col("_0").alias(f"{name}_x"), F.col("_1").alias(f"{name}_y"), F.col("own").alias(f"{name}_own"), "level", "cx", "cy", *[F.col(f"_{k}").alias(f"{name}_{k}") for k in range(4)])


def meeting(left: DataFrame, right: DataFrame, left_box: Sequence[Column], right_box: Sequence[Column], points: bool = False) -> DataFrame:
    """Pairs ``a, b`` (structs of the rows of both tables) whose boxes (left, bottom, right, top) share a place, each once.

    Boxes with a null, NaN or in the wrong order meet nothing. Points are boxes without sides; if ``points`` says that the
    left ones are, that side isn't looked at before the join, and may be a stream.
    """
    in_left, in_right = [] if points else _levels(left, left_box), _levels(right, right_box)
    least = min([*in_left, *in_right, HIGHEST]) if in_left or in_right else 0
    a = _sent(left, left_box, in_right, least, "a")
    b = _sent(right, right_box, in_left or [least], least, "b")
    pairs = a.join(b, ["level", "cx", "cy"])
    side = F.pow(F.lit(2.0), F.col("level"))
    home = (F.col("cx") == F.floor(F.greatest("a_x", "b_x") / side)) & (F.col("cy") == F.floor(F.greatest("a_y", "b_y") / side))
    touch = (F.col("a_0") <= F.col("b_2")) & (F.col("b_0") <= F.col("a_2")) & (F.col("a_1") <= F.col("b_3")) & (F.col("b_1") <= F.col("a_3"))
    return pairs.where((F.col("level") == F.greatest("a_own", "b_own")) & home & touch).select("a", "b")
