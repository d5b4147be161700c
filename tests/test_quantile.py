import random

import numpy as np
import pytest

from tallyrake.functions.quantile import exact_median, exact_quantile


def test_small_histogram_path(spark):
    vals = [3.0, 1.0, 2.0, 2.0, None, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert exact_median(df, "x") == pytest.approx(2.0)
    assert exact_quantile(df, "x", 0.25) == pytest.approx(np.percentile([3, 1, 2, 2, 10], 25))


def test_bucket_narrowing_path_is_exact(spark):
    rnd = random.Random(11)
    vals = [rnd.gauss(0, 1) for _ in range(5001)] + [0.5] * 300
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for p in (0.5, 0.1, 0.93):
        got = exact_quantile(df, "x", p, collect_limit=200)     # force several narrowing rounds
        assert got == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-12)


def test_extremes_ties_and_one_bucket_of_spread(spark):
    vals = [-1e308, 1e308, 5e-324, 0.0, -0.0, 1e-300, float("nan")] + [7.0] * 50
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    clean = [v for v in vals if v == v]
    for p in (0.0, 0.05, 0.5, 1.0):
        assert exact_quantile(df, "x", p, collect_limit=2) == pytest.approx(float(np.quantile(clean, p)))
    assert exact_median(df.filter("x is null"), "x") is None
