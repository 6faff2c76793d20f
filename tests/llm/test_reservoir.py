from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strataframe.llm.reservoir import Reservoir, _shares, part_shares, reservoir_sample


def test_reservoir_is_uniform_in_pieces():
    hits = Counter()
    for seed in range(4000):
        r, slots = Reservoir(3, np.random.default_rng(seed)), {}
        for start, size in ((0, 1), (1, 4), (5, 7)):
            for slot, k in r.offer(size):
                slots[slot] = start + k
        assert len(set(slots.values())) == 3
        hits.update(slots.values())
    expected = 4000 * 3 / 12
    assert sum((hits[k] - expected) ** 2 / expected for k in range(12)) < 31.3  # chi-square, 11 degrees, p = 0.001


def test_sample_is_uniform_over_unequal_parts(spark):
    df = spark.range(0, 40, 1, 2).union(spark.range(40, 44, 1, 1)).select("id", F.when(F.col("id") < 30, "x").alias("g"))
    hits = Counter()
    for seed in range(60):
        out = reservoir_sample(df, {"all": (None, 11)}, seed).collect()
        assert len({r.id for r in out}) == 11 and {r.population for r in out} == {44}
        hits.update(r.id for r in out)
    expected = 60 * 11 / 44
    assert sum((hits[k] - expected) ** 2 / expected for k in range(44)) * 44 / (44 - 11) < 77.4 * 1.5


def test_shares_of_more_than_a_thousand_million_rows():
    counts = [3 * 10**9, 10**12, 0, 5, 10**12]
    given = _shares({"all": 1000}, 4).func(pd.Series(["all"]), pd.Series([None]), pd.Series([counts]))[0]
    assert sum(given) == 1000 and given[2] == 0 and 400 < given[1] < 600 and 400 < given[4] < 600
    assert part_shares(np.array([2, 0, 3]), 9, random.Random(1)) == [2, 0, 3] and part_shares(np.array([5, 5]), 0, random.Random(1)) == [0, 0]
    hits = Counter(part_shares(np.array([2, 3]), 2, random.Random(k))[0] for k in range(4000))
    assert sum((hits[k] - 400 * e) ** 2 / (400 * e) for k, e in ((0, 3), (1, 6), (2, 1))) < 13.9  # chi-square, 2 degrees, p = 0.001


def test_groups_nulls_small_groups_clashes_and_empty(spark):
    df = spark.createDataFrame([(k, "a" if k < 50 else None, k) for k in range(53)], "id long, key string, part long")
    out = reservoir_sample(df, {"all": (None, 5), "by": ("key", 10)}, 1)
    assert out.columns == ["scope", "key", "population", "id", "in_key", "in_part"]
    counts = Counter((r.scope, r.key, r.population) for r in out.collect())
    assert counts == {("all", None, 53): 5, ("by", "a", 50): 10, ("by", None, 3): 3}
    assert reservoir_sample(df.limit(0), {"all": (None, 5)}).count() == 0


def test_keys_with_one_ending_draw_differently(spark):
    names = ["alpha-northern-highland-site", "omega-northern-highland-site"]
    df = spark.range(0, 4000, 1, 1).select((F.col("id") % 2000).alias("id"), F.when(F.col("id") < 2000, names[0]).otherwise(names[1]).alias("g"))
    out = reservoir_sample(df, {"by": ("g", 50)}, 3).collect()
    drawn = [{r.id for r in out if r.key == n} for n in names]
    assert len(drawn[0]) == len(drawn[1]) == 50 and len(drawn[0] & drawn[1]) < 20
