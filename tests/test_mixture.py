"""Gamma tails against tables, simulation and fallbacks."""

import math
import random

import numpy as np
import pytest

from gaugeline.operators import mixture


@pytest.mark.parametrize(("freedom", "p", "x"), [(1, 0.95, 3.841), (1, 0.01, 0.000157), (2, 0.5, 1.386), (5, 0.99, 15.086), (10, 0.05, 3.940), (10, 0.95, 18.307), (30, 0.975, 46.979), (100, 0.95, 124.342), (100, 0.01, 70.065)])
def test_tabulated_quantiles(freedom, p, x):
    """Chi-squared quantiles, as printed in tables."""
    assert 2 * mixture.gamma_quantile(freedom / 2, p) == pytest.approx(x, abs=6e-4)


@pytest.mark.parametrize("a", [0.05, 0.3, 1.0, 4.5, 80.0, 4e6])
def test_quantiles_and_shares_are_inverse(a):
    for p in (1e-6, 0.01, 0.5, 0.9, 0.999999):
        assert mixture.gamma_share(a, mixture.gamma_quantile(a, p)) == pytest.approx(p, rel=1e-6)
    assert mixture.gamma_share(1.0, 2.5) == pytest.approx(1 - math.exp(-2.5))


def test_tail_of_moments():
    x = np.random.default_rng(1).gamma(2.0, 3.0, 2_000_000) + 7
    m, v = x.mean(), x.var()
    skew = ((x - m) ** 3).mean() / v**1.5
    for p in (0.5, 0.9, 0.99):
        assert mixture.tail(m, v, skew, p) == pytest.approx(np.quantile(x, p), rel=0.01)
        assert mixture.tail(-m, v, -skew, 1 - p) == pytest.approx(-np.quantile(x, p), rel=0.01)
    assert mixture.tail(1.0, 4.0, 0.0, 0.975) == pytest.approx(1 + 2 * 1.959964, abs=1e-5)


def test_thresholds(spark):
    rng = np.random.default_rng(2)
    two = np.concatenate([rng.normal(0, 1, 900), rng.gamma(4, 1, 300) + 12])
    df = spark.createDataFrame([(float(v),) for v in two] + [(None,), (float("nan"),)], "v double")
    tau, k = mixture.mixture_threshold(df, "v", 0.02)
    assert k >= 2 and 0.01 < (two > tau).mean() < 0.035
    # the highest component is smaller than what is to exceed: the quantile of all rows
    few = np.concatenate([rng.normal(0, 1, 990), rng.normal(50, 1, 10)])
    tau, k = mixture.mixture_threshold(spark.createDataFrame([(float(v),) for v in few], "v double"), "v", 0.05)
    assert k >= 2 and tau == pytest.approx(np.quantile(few, 0.95))
    # as many components as different scores
    rnd = random.Random(3)
    for values in ([3.0] * 40, [rnd.choice([1.0, 2.0]) for _ in range(60)]):
        tau, k = mixture.mixture_threshold(spark.createDataFrame([(v,) for v in values], "v double"), "v", 0.1)
        assert k <= len(set(values)) and (tau == 3.0 or len(set(values)) > 1)
    assert mixture.gamma_quantile(0.01, 1e-6) == 0.0
    assert mixture.mixture_threshold(df.limit(0), "v", 0.1)[1] == 0
