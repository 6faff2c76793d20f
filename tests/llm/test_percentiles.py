from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.llm.percentiles import combined, percentiles, value_counts


def exact(values, permille):
    v = sorted(values)
    return v[max(1, (len(v) * permille + 999) // 1000) - 1]


@pytest.mark.parametrize("error", [0, 0.0625, 1.0])
def test_against_sorting(spark, error):
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(0, 100, 2000), "b": rng.lognormal(3, 2, 500), None: np.array([5.0]), "wild": np.array([-3.4e38, 1e300, 0.0, 0.1])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("b", float("inf"))]
    df = spark.createDataFrame(rows, "g string, value double")
    out = {r.g: r for r in percentiles(value_counts(df, ["g"], "value", error), ["g"], (0, 100, 500, 999, 1000), error).collect()}
    assert set(out) == set(groups)
    for g, vs in groups.items():
        assert out[g].n == len(vs)
        for p in (0, 100, 500, 999, 1000):
            want = exact(vs, p)
            assert abs(out[g][f"p{p:03d}"] - want) <= error + 1e-12 * abs(want)


def test_states_combine(spark):
    df = spark.range(5000).select((F.col("id") % 7).cast("string").alias("g"), (F.col("id") % 5).alias("day"), (F.sin("id") * 1000).alias("value"))
    whole = percentiles(value_counts(df, ["g"], "value"), ["g"])
    days = value_counts(df, ["g", "day"], "value")
    assert sorted(percentiles(combined(days, ["g"]), ["g"]).collect()) == sorted(whole.collect()) == sorted(percentiles(days, ["g"]).collect())


def test_hot_value_and_empty(spark):
    df = spark.range(3000).select(F.lit("g").alias("n"), F.when(F.col("id") < 2900, 7.0).otherwise(F.col("id").cast("double")).alias("value"))
    r = percentiles(value_counts(df.withColumnRenamed("n", "k"), ["k"], "value"), ["k"]).first()
    assert (r.n, r.p050, r.p950) == (3000, 7.0, 7.0)
    assert percentiles(value_counts(df.limit(0).withColumnRenamed("n", "k"), ["k"], "value"), ["k"]).count() == 0


def test_relative_steps(spark):
    rng = np.random.default_rng(2)
    values = [float(v) for v in np.r_[rng.lognormal(-6, 6, 3000), -rng.lognormal(2, 3, 500), 0.0, 5e-324, 1e308, -0.05, 0.07]]
    df = spark.createDataFrame([("g", v) for v in values], "g string, value double")
    counts = value_counts(df, ["g"], "value", 0.01, relative=True)
    assert counts.count() < 2600
    row = percentiles(counts, ["g"], (0, 30, 500, 900, 1000), 0.01, relative=True).first()
    for p in (0, 30, 500, 900, 1000):
        want = exact(values, p)
        assert abs(row[f"p{p:03d}"] - want) <= 0.01 * abs(want) + 1e-300


def test_one_group_of_as_many_ranges_as_rows(spark):
    df = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") * 5e4 + 7).alias("value"))
    out = percentiles(value_counts(df, ["g"], "value"), ["g"])
    row = out.first()
    assert (row.n, row.p050, row.p500, row.p950) == (20_000, 999 * 5e4 + 7, 9_999 * 5e4 + 7, 18_999 * 5e4 + 7)
