"""Statistics of valid cells or points as aggregates; null is invalid, the standard deviation is that of the population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.values import clean
from strataframe.plans.running import running_sum
from strataframe.plans.workspace import store

NMAD_FACTOR = 1.4826
#: Names of statistics by their short forms.
ALIASES = {
    "mean": "mean", "average": "mean", "median": "median", "max": "max", "maximum": "max", "min": "min", "minimum": "min", "sum": "sum",
    "sumofsquares": "sum_of_squares", "sum2": "sum_of_squares", "percentile": "p90", "90thpercentile": "p90", "90percentile": "p90", "p90": "p90",
    "iqr": "iqr", "le90": "le90", "nmad": "nmad", "rmse": "rmse", "rms": "rmse", "std": "std", "standarddeviation": "std", "stddev": "std",
    "validcount": "valid_count", "totalcount": "total_count", "percentagevalidpoints": "percent_valid", "percentvalid": "percent_valid",
    "validinliercount": "valid_inlier_count", "totalinliercount": "total_inlier_count", "percentinlier": "percent_inlier", "percentvalidinlier": "percent_valid_inlier",
    "percentageinlierpoints": "percent_inlier", "percentagevalidinlierpoints": "percent_valid_inlier",
}
ONE_PASS = ("mean", "median", "max", "min", "sum", "sum_of_squares", "p90", "le90", "iqr", "rmse", "std", "valid_count", "total_count", "percent_valid")
INLIER = ("valid_inlier_count", "total_inlier_count", "percent_inlier", "percent_valid_inlier")


def stat_name(name: str) -> str:
    """Canonical name of a statistic, whatever its spelling; an unknown name raises."""
    key = "".join(c for c in name.lower() if c.isalnum())
    if key not in ALIASES:
        raise ValueError(f"unknown statistic: {name!r}")
    return ALIASES[key]


def linear_error(x: Column, interval: float = 90) -> Column:
    """Width between the percentiles that hold the middle ``interval`` percent."""
    if not 0 < interval <= 100:
        raise ValueError("the interval must be above 0 and at most 100")
    return F.percentile(x, (50 + interval / 2) / 100) - F.percentile(x, (50 - interval / 2) / 100)


def _one_pass(x: Column, name: str) -> Column:
    return {
        "mean": lambda: F.avg(x), "median": lambda: F.median(x), "max": lambda: F.max(x), "min": lambda: F.min(x), "sum": lambda: F.sum(x),
        "sum_of_squares": lambda: F.sum(x * x), "p90": lambda: F.percentile(x, 0.9), "le90": lambda: linear_error(x, 90),
        "iqr": lambda: F.percentile(x, 0.75) - F.percentile(x, 0.25), "rmse": lambda: F.sqrt(F.avg(x * x)), "std": lambda: F.stddev_pop(x),
        "valid_count": lambda: F.count(x), "total_count": lambda: F.count(F.lit(1)), "percent_valid": lambda: 100.0 * F.try_divide(F.count(x), F.count(F.lit(1))),
    }[name]()


#: Rows up to which exact percentiles are aggregates, which keep a group's different values in one task.
AGGREGATED = 10_000_000


def exact_percentiles(df: DataFrame, value: str, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by, q0, q1, ...``: interpolated percentiles by cumulative counts of values, however large a group is.

    Values are counted, sorted by range and summed with the offsets of the ranges before; ranks are then looked up. Nulls
    are left out; groups without values don't appear.
    """
    counts = store(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "counts")
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    summed = running_sum(counts, list(by), ["_v"], "_n", "_upto")
    placed = summed.alias("s").join(totals.alias("t"), [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in by]) if by else summed.crossJoin(F.broadcast(totals))  # one row
    keys = [F.col(f"s.{k}").alias(k) for k in by]
    rank = lambda f: (F.col("_total") - 1) * float(f)
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v")))
    low, high = ([at(rule(rank(f))) for f in fractions] for rule in (F.floor, F.ceil))
    ends = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *[c.alias(f"_{k}_{n}") for n, part in (("l", low), ("h", high)) for k, c in enumerate(part)])
    part = lambda k, f: F.col(f"_{k}_l") + (F.col(f"_{k}_h") - F.col(f"_{k}_l")) * (rank(f) - F.floor(rank(f)))
    return ends.select(*by, *[part(k, f).alias(f"q{k}") for k, f in enumerate(fractions)])


#: The percentiles that statistics are made of, and how.
_FROM_PERCENTILES = {"median": lambda q: q(0.5), "p90": lambda q: q(0.9), "le90": lambda q: q(0.95) - q(0.05), "iqr": lambda q: q(0.75) - q(0.25)}


def _large_stats(base: DataFrame, wanted: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``by`` and those of ``wanted`` that need percentiles, by cumulative counts."""
    fractions = sorted({0.5, *[f for n in wanted for f in {"p90": (0.9,), "le90": (0.05, 0.95), "iqr": (0.25, 0.75)}.get(n, ())]})
    found = exact_percentiles(base, "_x", fractions, by)
    q = lambda f: F.col(f"q{fractions.index(f)}")
    out = found.select(*by, *[rule(q).alias(n) for n, rule in _FROM_PERCENTILES.items() if n in wanted], q(0.5).alias("_centre"))
    if "nmad" in wanted:
        on = [F.col(f"b.{k}").eqNullSafe(F.col(f"o.{k}")) for k in by]
        both = base.alias("b").join(out.select(*by, "_centre").alias("o"), on) if by else base.crossJoin(F.broadcast(out.select("_centre")))  # one row
        away = exact_percentiles(both.select(*[F.col(f"b.{k}").alias(k) for k in by], F.abs(F.col("_x") - F.col("_centre")).alias("_d")), "_d", [0.5], by)
        away = away.select(*by, (NMAD_FACTOR * F.col("q0")).alias("nmad"))
        out = out.alias("l").join(away.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]).select("l.*", "nmad") if by else out.crossJoin(away)  # one row each
    return out.drop("_centre")


def get_stats(df: DataFrame, value: str = "value", names: Sequence[str] | None = None, by: Sequence[str] = (), inlier: Column | None = None) -> DataFrame:
    """One row (per group of ``by``) with a column per statistic.

    With ``inlier``, the computed statistics take cells where it is true; the counts of all cells stay and those of
    inliers join them. One aggregate gives everything but the NMAD, which needs the median of the first. Above
    :data:`AGGREGATED` rows, percentiles come from cumulative counts instead, with the same results.
    """
    inside = F.coalesce(inlier, F.lit(False)) if inlier is not None else F.lit(True)
    wanted = [stat_name(n) for n in names] if names is not None else [*ONE_PASS[:9], "nmad", *ONE_PASS[9:], *(INLIER if inlier is not None else ())]
    base = df.select(*by, clean(F.col(value)).alias("_all"), inside.alias("_in"))
    base = base.withColumn("_x", F.when(F.col("_in"), F.col("_all")))
    whole = {"valid_count", "total_count", "percent_valid"}
    aggregates = [_one_pass(F.col("_all" if n in whole else "_x"), n).alias(n) for n in wanted if n in ONE_PASS]
    extra = {
        "valid_inlier_count": F.count("_x"), "total_inlier_count": F.count_if("_in"),
        "percent_inlier": 100.0 * F.try_divide(F.count("_x"), F.count("_all")),
        "percent_valid_inlier": F.coalesce(100.0 * F.try_divide(F.count("_x"), F.count_if("_in")), F.lit(0.0)),
    }
    aggregates += [extra[n].alias(n) for n in wanted if n in INLIER]
    ranked = [n for n in wanted if n == "nmad" or n in _FROM_PERCENTILES]
    if ranked and base.count() > AGGREGATED:
        rest = [a for n, a in zip([n for n in wanted if n in ONE_PASS] + [n for n in wanted if n in INLIER], aggregates, strict=True) if n not in ranked]
        out = base.groupBy(*by).agg(*rest, F.lit(0).alias("_none"))
        large = _large_stats(base.select(*by, "_x"), ranked, by)
        out = out.alias("l").join(large.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by], "left").select("l.*", *[f"r.{n}" for n in ranked]) if by else out.join(F.broadcast(large), how="left")  # one row each
        return out.select(*by, *wanted)
    out = base.groupBy(*by).agg(*aggregates, F.lit(0).alias("_none"))
    if "nmad" in wanted:
        out = out.join(nmad(base, "_x", by), list(by)) if by else out.crossJoin(nmad(base, "_x", by))  # one row each
    return out.select(*by, *wanted)


def nmad(df: DataFrame, value: str = "value", by: Sequence[str] = (), factor: float = NMAD_FACTOR) -> DataFrame:
    """Normalised median absolute deviation, per group."""
    centre = df.groupBy(*by).agg(F.median(value).alias("_centre"))
    joined = df.join(centre, list(by)) if by else df.crossJoin(F.broadcast(centre))  # one row
    return joined.groupBy(*by).agg((factor * F.median(F.abs(F.col(value) - F.col("_centre")))).alias("nmad"))
