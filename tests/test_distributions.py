"""Quantile helpers against published values, binomial tail sums and symmetry."""

from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from armwatch.functions import distributions
from armwatch.functions.distributions import (
    beta_cdf, beta_ppf, beta_quantile, hdi_bounds, t_ppf, t_quantile)


def one(function, *args):
    return float(function(*(np.array([float(a)]) for a in args))[0])


@pytest.mark.parametrize("prob, df, value", [
    (.975, 1, 12.7062047362), (.975, 10, 2.2281388520), (.95, 30, 1.6972608866),
    (.995, 5, 4.0321429836), (.025, 10, -2.2281388520), (.5, 7, 0.0)])
def test_t_table(prob, df, value):
    assert one(t_ppf, prob, df) == pytest.approx(value, abs=1e-9)


def test_published_exact_interval():
    # 5 of 100, 95 %: 0.0164 to 0.1128
    assert one(beta_ppf, .025, 5, 96) == pytest.approx(.01643188, abs=1e-8)
    assert one(beta_ppf, .975, 6, 95) == pytest.approx(.11283491, abs=1e-8)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(0, 60), st.floats(1e-6, 1 - 1e-6))
def test_binomial_tail_identity(x, more, prob):
    n = x + more
    q = one(beta_ppf, prob, x, n - x + 1)
    tail = sum(comb(n, k) * q ** k * (1 - q) ** (n - k) for k in range(x, n + 1))
    assert tail == pytest.approx(prob, rel=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.floats(.3, 1e6), st.floats(.3, 1e6), st.floats(1e-4, 1 - 1e-4))
def test_inverse_and_symmetry(a, b, prob):
    x = one(beta_ppf, prob, a, b)
    if 0 < x < 1:
        assert one(beta_cdf, x, a, b) == pytest.approx(prob, rel=1e-8, abs=1e-10)
    assert x == pytest.approx(1 - one(beta_ppf, 1 - prob, b, a), abs=1e-8)


def test_quadrature_meets_continued_fraction():
    import armwatch.functions.distributions as d
    a, b, x = np.array([3500., 4000.]), np.array([50000., 4000.]), np.array([.064, .49])
    fraction = np.exp(d._log_front(x, a, b)) * d._tail_fraction(x, a, b) / a
    assert d._tail_integral(x, a, b) == pytest.approx(fraction, rel=1e-12)


def test_huge_counts():
    q = beta_ppf(np.array([.01, .99]), np.full(2, 1e8), np.full(2, 1e11))
    assert beta_cdf(q, np.full(2, 1e8), np.full(2, 1e11)) == pytest.approx([.01, .99], abs=1e-9)


def test_shortest_interval_against_grid():
    a, b, mass = 4.0, 37.0, .9
    low, high = (float(v[0]) for v in hdi_bounds(np.array([mass]), np.array([a]), np.array([b])))
    tails = np.linspace(0, 1 - mass, 4001)
    widths = (beta_ppf(tails + mass, np.full_like(tails, a), np.full_like(tails, b))
              - beta_ppf(tails, np.full_like(tails, a), np.full_like(tails, b)))
    best = tails[np.argmin(widths)]
    assert high - low <= widths.min() + 1e-9
    assert one(beta_cdf, low, a, b) == pytest.approx(best, abs=1e-4)


def test_shortest_interval_at_a_border():
    low, high = hdi_bounds(np.array([.9, .9]), np.array([1., 31.]), np.array([31., 1.]))
    assert low[0] == 0 and high[1] == 1
    assert high[0] == pytest.approx(1 - low[1])


SHAPES = [(1., 1.), (.5, .5), (.3, .3), (.5, 10.), (5., 96.), (6., 95.), (1., 1000.), (900., 17.),
          (2000., .5), (4000.5, .5), (2900., 1e6), (2900., 1e9), (2999., 2999.), (3500., 5e4),
          (4000., 4000.), (1e6, 2e6), (1e8, 1e11), (.5, 1e7), (40., 1e10)]
PROBS = [1e-6, .01, .055, .11, .5, .945, .99]


def test_quantile_columns_against_arrays(spark):
    rows = [(q, a, b) for q in PROBS for a, b in SHAPES]
    df = spark.createDataFrame(rows, "q double, a double, b double").repartition(8)
    chosen = df.select("q", "a", "b", beta_quantile(F.col("q"), F.col("a"), F.col("b")).alias("x"),
                       t_quantile(F.col("q"), F.col("a")).alias("t"))
    assert "Python" not in chosen._jdf.queryExecution().executedPlan().toString()
    found = chosen.collect()
    assert len(found) == len(rows)
    for r in found:
        # The arrays stop at an error of 1e-14 in the probability.
        assert r.x == pytest.approx(one(beta_ppf, r.q, r.a, r.b), rel=1e-7), r
        if .01 <= r.q <= .99 and r.a >= 1:
            assert r.t == pytest.approx(one(t_ppf, r.q, r.a), rel=1e-8, abs=1e-8), r


def test_quantile_columns_at_borders_and_odd_values(spark):
    nan = float("nan")
    rows = [(None, 1., 1.), (.5, None, 1.), (.5, 1., None), (.5, -1., 1.), (.5, 0., 1.),
            (2., 1., 1.), (-.1, 1., 1.), (nan, 1., 1.), (.5, nan, 1.), (.5, 1., nan)]
    odd = spark.createDataFrame(rows, "q double, a double, b double")
    assert odd.where(beta_quantile(F.col("q"), F.col("a"), F.col("b")).isNotNull()).count() == 0
    ends = spark.createDataFrame([(0.,), (1.,)], "q double").select(
        beta_quantile(F.col("q"), F.lit(2.), F.lit(3.)).alias("x"))
    assert [r.x for r in ends.collect()] == [0., 1.]
    # One degree of freedom is a Cauchy distribution.
    cauchy = spark.range(1).select(t_quantile(.999999, F.lit(1.)).alias("t")).first().t
    assert cauchy == pytest.approx(np.tan(np.pi * .499999), rel=1e-9)


def test_unsettled_searches_give_null(spark, monkeypatch):
    monkeypatch.setattr(distributions, "STEPS", 1)
    short = spark.range(1).select(beta_quantile(.01, F.lit(5.), F.lit(96.)).alias("x"))
    assert short.first().x is None
    monkeypatch.setattr(distributions, "STEPS", 200)
    monkeypatch.setattr(distributions, "TERMS", 2)
    assert spark.range(1).select(
        beta_quantile(.4, F.lit(900.), F.lit(700.)).alias("x")).first().x is None
