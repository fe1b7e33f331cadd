"""Exact percentiles by narrowing histograms, against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltgrid.operators import quantiles

Q = {"least": 0.0, "p1": 0.01, "q1": 0.25, "median": 0.5, "p95": 0.95, "most": 1.0}


@pytest.mark.parametrize(("bins", "levels"), [(4096, 2), (2, 1), (3, 4)])
def test_percentiles_of_any_distribution(spark, bins, levels):
    rng = random.Random(bins)
    samples = {
        "even": [rng.uniform(-3, 9) for _ in range(501)],
        "ties": [rng.choice([1.0, 2.0, 2.0, 2.0]) for _ in range(300)],
        "one value": [7.5] * 40,
        "single": [-2.0],
        "two": [1.0, 4.0],
        "far out": [rng.gauss(0, 1) for _ in range(200)] + [1e308, -1e308],
        "zeros": [0.0, -0.0, 0.0, 1.0],
        None: [rng.expovariate(1) for _ in range(77)],
        "nothing": [None, math.nan, math.inf, -math.inf],
    }
    rows = [(g, x) for g, values in samples.items() for x in values] + [("even", None), ("even", math.nan)]
    rng.shuffle(rows)
    got = {r.k: r for r in quantiles.percentiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", Q, bins, levels).collect()}
    assert set(got) == set(samples)
    for g, values in samples.items():
        if g == "nothing":
            assert got[g].n == 0 and got[g].median is None
            continue
        assert got[g].n == len(values)
        for name, q in Q.items():
            assert got[g][name] == pytest.approx(np.percentile(np.array(values), 100 * q), rel=1e-12, abs=1e-300)


def test_percentiles_of_the_whole_and_of_several_keys(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"), F.col("id").cast("double").alias("x"), F.lit("v").alias("g"), F.lit(1).alias("cell"))
    assert quantiles.percentiles(df, [], "x", {"m": 0.5}).first().m == 499.5
    got = {(r.a, r.b): r.m for r in quantiles.percentiles(df, ["a", "b"], -F.col("x"), {"m": 0.5}).collect()}
    assert len(got) == 6 and got[0, 0] == -np.median([i for i in range(1000) if i % 6 == 0])
    assert quantiles.percentiles(df.limit(0), ["a"], "x", {"m": 0.5}).count() == 0
