"""Cell values: null stands for no data, and arithmetic with it, or outside a function's domain, gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(value: Column, nodata: float | None = None) -> Column:
    """Null for NaN, infinities and the nodata value."""
    x = value.cast("double")
    kept = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return kept if nodata is None or nodata != nodata else F.when(kept != float(nodata), kept)


def floor_divide(a: Column, b: Column) -> Column:
    """Towards minus infinity; null by zero."""
    return F.floor(F.try_divide(a, b)).cast("double")


def modulo(a: Column, b: Column) -> Column:
    """With the divisor's sign; null by zero."""
    return a - b * F.floor(F.try_divide(a, b))


def power(a: Column, k: Column) -> Column:
    return clean(F.pow(a, k))


def both(a: Column, b: Column, result: Column) -> Column:
    """Logic that is null if either side is."""
    return F.when(a.isNotNull() & b.isNotNull(), result)


ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: F.try_divide(a, b),
    "floordiv": floor_divide, "mod": modulo, "pow": power,
}
COMPARISON: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
}
LOGIC: dict[str, Callable[[Column, Column], Column]] = {
    "and": lambda a, b: both(a, b, a & b), "or": lambda a, b: both(a, b, a | b), "xor": lambda a, b: both(a, b, a != b),
}
#: Functions of one value; results outside their domains are null.
UNARY: dict[str, Callable[[Column], Column]] = {
    "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "expm1": F.expm1, "log": F.log, "log10": F.log10, "log2": F.log2, "log1p": F.log1p,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "degrees": F.degrees, "radians": F.radians, "floor": lambda x: F.floor(x).cast("double"),
    "ceil": lambda x: F.ceil(x).cast("double"), "rint": F.rint, "trunc": lambda x: F.signum(x) * F.floor(F.abs(x)), "sign": F.signum, "abs": F.abs,
    "negative": lambda x: -x, "square": lambda x: x * x, "reciprocal": lambda x: F.try_divide(F.lit(1.0), x),
}
#: Functions of two values besides the operators.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "maximum": lambda a, b: both(a, b, F.greatest(a, b)), "minimum": lambda a, b: both(a, b, F.least(a, b)), "fmax": F.greatest, "fmin": F.least,
    "hypot": F.hypot, "arctan2": F.atan2, "copysign": lambda a, b: F.abs(a) * F.when(b < 0, -1.0).otherwise(1.0), "logaddexp": lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))),
}


def apply_unary(name: str, x: Column) -> Column:
    """A named function of one value."""
    if name not in UNARY:
        raise ValueError(f"unknown function: {name!r}")
    return clean(UNARY[name](x))
