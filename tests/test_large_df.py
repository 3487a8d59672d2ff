"""Tails at many degrees of freedom, against Gauss-Legendre sums of the densities in extended precision."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.functions import large, stats

NODES, WEIGHTS = np.polynomial.legendre.leggauss(120)
DF = [2e4, 1e5, 3e6, 1e9, 1e12]


def _integral(f, a, b, parts):
    edges = np.linspace(a, b, parts + 1, dtype=np.longdouble)
    total = np.longdouble(0)
    for lo, hi in zip(edges[:-1], edges[1:]):
        x = (hi - lo) / 2 * NODES.astype(np.longdouble) + (hi + lo) / 2
        total += (hi - lo) / 2 * (WEIGHTS.astype(np.longdouble) * f(x)).sum()
    return total


def t_tail(t, df):
    """Both parts by integration, so that no gamma function is needed."""
    df = np.longdouble(df)
    f = lambda x: np.exp(-(df + 1) / 2 * np.log1p(x * x / df))
    far = max(t, 0) + 42.0 / max(1.0, t / 2)
    return float(_integral(f, t, far, 40) / _integral(f, 0, 40, 60))


def chi2_tail(z, dof):
    """The tail beyond dof + z standard deviations, the density in units of these."""
    s = np.longdouble(dof) / 2
    step = np.sqrt(np.longdouble(2) * dof)

    def f(v):
        mu = v * step / dof
        series = sum(((-1) ** k * mu ** k / (k + 2) for k in range(40)), np.longdouble(0)) * mu * mu
        less = np.where(np.abs(mu) < 0.25, series, mu - np.log1p(mu))
        return np.exp(-s * less - np.log1p(mu))

    return float(_integral(f, z, z + 60, 60) / _integral(f, -40, 60, 100))


def test_t_tail(spark):
    cases = [(t, df) for df in DF for t in (0.0, 1e-3, 0.4, 1.0, 1.96, 5.0, 12.0, 30.0)]
    rows = spark.createDataFrame(cases, "t double, df double").select("t", "df", stats.t_p_value_col("t", "df").alias("p")).collect()
    for r in rows:
        assert math.isclose(r.p, t_tail(r.t, r.df), rel_tol=1e-10), (r.t, r.df)


def test_t_tail_meets_the_continued_fraction(spark):
    cases = [(t, df) for df in (9_999.0, 10_000.0, 10_001.0) for t in (0.1, 1.0, 3.0, 9.0)]
    rows = spark.createDataFrame(cases, "t double, df double").select("t", "df", stats.t_p_value_col("t", "df").alias("p")).collect()
    for r in rows:
        assert math.isclose(r.p, t_tail(r.t, r.df), rel_tol=1e-9), (r.t, r.df)


def test_t_quantile(spark):
    rows = stats.with_t_tests(spark.createDataFrame([(df,) for df in DF], "df double"), "df", "df", q=0.975, q_out="q").collect()
    for r in rows:
        assert math.isclose(t_tail(r.q, r.df), 0.05, rel_tol=1e-10)
    assert math.isclose(rows[-1].q, 1.959963984540054, rel_tol=1e-10)


def test_chi2_tail(spark):
    zs = (-8.0, -3.0, -0.5, -1e-3, 0.0, 1e-4, 0.7, 2.0, 6.0, 15.0)
    # the deviation that the doubles really hold
    cases = [(dof + z * math.sqrt(2 * dof), dof) for dof in DF for z in zs]
    rows = spark.createDataFrame(cases, "x double, dof double").select("x", "dof", stats.chi2_sf_col("x", "dof").alias("p")).collect()
    for r in rows:
        z = (r.x - r.dof) / math.sqrt(2 * r.dof)
        assert math.isclose(r.p, chi2_tail(z, r.dof), rel_tol=1e-10), (z, r.dof)


def test_edges(spark):
    rows = spark.createDataFrame([(0.0, 1e6), (1e9, 1e6), (1e-300, 1e6), (None, 1e6), (float("nan"), 1e6)], "x double, df double")
    got = rows.select(stats.chi2_sf_col("x", "df").alias("c"), stats.t_p_value_col("x", "df").alias("t")).collect()
    assert [r.c for r in got] == [1.0, 0.0, 1.0, None, None]
    assert [r.t for r in got] == [1.0, 0.0, 1.0, None, None]


def test_correction_starts_as_published():
    # fixed values: the first coefficients of the expansion
    assert np.allclose(large.CORRECTION[0][:4], [-1 / 3, 1 / 12, -2 / 135, 1 / 864])
    assert np.allclose(large.CORRECTION[1][:2], [-1 / 540, -1 / 288])
    assert large.CORRECTION[2][0] == pytest.approx(25 / 6048)
