from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from strataframe.llm.mix import VOCABULARY, mix, source_name, token_counts


def test_shares_caps_and_repeats(spark):
    records = spark.range(3000).select("id", F.when(F.col("id") < 2000, "big").when(F.col("id") < 2900, "mid").otherwise("tiny").alias("source"), (50 + F.col("id") % 100).alias("size"), (1 + F.col("id") % 3).alias("weight"))
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.5, 8), ("tiny", 0.2, 2), ("ghost", 0.1, 3), ("none", None, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mix(records, targets, total=220_000, seed=3)
    got = {r.source: r for r in report.collect()}
    rows = chosen.collect()
    assert len({r.id for r in rows}) == len(rows) and all(r.copies >= 1 for r in rows)
    for name, cap in (("big", 1), ("mid", 8), ("tiny", 2)):
        mine = [r for r in rows if r.source == name]
        assert max(r.copies for r in mine) <= cap and sum(r.size * r.copies for r in mine) == got[name].reached_size
    assert abs(got["big"].reached_size - got["big"].target_size) <= 75 and abs(got["mid"].reached_size - got["mid"].target_size) <= 75
    assert got["tiny"].reached_size == 2 * got["tiny"].available  # its cap is below its target
    assert got["ghost"].reached_size == 0 and got["none"].target_size == 0
    heavy = [r.copies for r in rows if r.source == "mid" and r.id % 3 == 2]
    light = [r.copies for r in rows if r.source == "mid" and r.id % 3 == 0]
    assert sum(heavy) / 300 > 2 * sum(light) / 300


def test_target_is_met_with_widely_spread_weights(spark):
    records = spark.range(60).select("id", F.lit("s").alias("source"), F.lit(10).alias("size"), F.pow(F.lit(1000.0), F.col("id")).alias("weight"))
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mix(records, targets, total=500)
    assert report.first().reached_size == 500 and {r.id for r in chosen.collect()} >= set(range(11, 60))


def test_inclusion_follows_chances(spark):
    records = spark.range(200).select("id", F.lit("s").alias("source"), F.lit(10).alias("size"), F.when(F.col("id") < 100, 1.0).otherwise(3.0).alias("weight"))
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    heavy = 0
    for seed in range(8):
        rows = mix(records, targets, total=600, seed=seed)[0].collect()
        assert len(rows) == 60
        heavy += sum(r.id >= 100 for r in rows)
    assert 8 * 45 - 60 < heavy < 8 * 45 + 60


def test_nulls_empty_names(spark):
    df = spark.createDataFrame([(1, "a", 10, 1.0), (None, "a", 10, 1.0), (2, None, 10, 1.0), (3, "a", 0, 1.0), (4, "a", 10, None)], "id long, source string, size int, weight double")
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats int")
    assert [(r.id, r.copies) for r in mix(df, targets, total=30)[0].collect()] == [(1, 3)]
    chosen, report = mix(df.limit(0), targets)
    assert chosen.count() == 0 and report.first().reached_size == 0
    names = spark.createDataFrame([(" Some_Name ",), ("SOME-NAME",), ("  ",), (None,)], "s string")
    assert [r[0] for r in names.select(source_name("s")).collect()] == ["some-name", "some-name", None, None]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "the cat sat"), (2, None), (3, ""), (4, "a" * 100_000)], "doc_id long, text string").selectExpr("*", "7 AS tokens")
    out = {r.doc_id: r.tokens for r in token_counts(df).collect()}
    assert out[1] == 3 and out[2] == 0 and out[3] == 0 and out[4] > 1000
