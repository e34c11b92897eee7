import math
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.llm.stats import false_discovery, hypergeom_upper, lgamma, log_normal_upper, poisson_binomial_upper


def test_lgamma():
    x = np.array([1e-3, 0.5, 1, 2, 7.5, 100, 1e6, 1e12])
    assert np.allclose(lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("k,K,n,N", [(0, 5, 5, 20), (1, 5, 5, 20), (3, 5, 5, 20), (5, 5, 5, 20), (6, 5, 5, 20), (4, 4, 9, 10), (3, 10, 100, 5000), (7, 7, 7, 7), (2, 0, 3, 9)])
def test_hypergeometric_exact(k, K, n, N):
    p = sum(Fraction(comb(K, j) * comb(N - K, n - j), comb(N, n)) for j in range(k, min(K, n) + 1) if n - j <= N - K)
    got = hypergeom_upper([k], [K], [n], [N])[0]
    assert got == (math.inf if p == 0 else pytest.approx(-math.log(p), abs=1e-9))


def test_hypergeometric_large():
    got = hypergeom_upper(np.array([1, 50, 3_000]), np.array([10, 10**6, 10**6]), np.array([1000, 1000, 10**4]), 10**9)
    assert np.isfinite(got).all() and got[0] == pytest.approx(-math.log(1e-5), abs=0.01) and got[1] > 150


def test_poisson_binomial_against_convolution():
    count, p = np.array([30.0, 50.0, 7.0]), np.array([0.02, 0.05, 0.3])
    pmf = np.ones(1)
    for m, q in zip(count.astype(int), p):
        for _ in range(m):
            pmf = np.convolve(pmf, [1 - q, q])
    c = np.arange(0, 40)
    want = -np.log(np.array([pmf[i:].sum() for i in c]))
    got = poisson_binomial_upper(c, count, np.tile(p, (len(c), 1)))
    assert got[0] == 0
    assert np.all(np.abs(got - want) < 0.06 + 0.01 * want)
    assert poisson_binomial_upper(np.array([88.0]), count, p[None, :])[0] == math.inf


def test_normal_tail():
    w = np.array([-3.0, 0.0, 5.0, 19.0, 21.0, 60.0])
    want = [math.log(0.5 * math.erfc(x / math.sqrt(2))) if x < 30 else -0.5 * x * x - math.log(x) - 0.5 * math.log(2 * math.pi) for x in w]
    assert np.allclose(log_normal_upper(w), want, rtol=1e-3)


def test_false_discovery(spark):
    p = np.sort(np.random.default_rng(1).random(200) ** 3)
    m = 500
    bh = np.minimum.accumulate((m * p / np.arange(1, 201))[::-1])[::-1]
    df = spark.createDataFrame([(i, float(-math.log(x))) for i, x in enumerate(p)], "i long, s double")
    q = [r["q"] for r in false_discovery(df, "s", m).orderBy("i").collect()]
    want = np.minimum(1, bh)
    assert np.all(np.array(q) >= want - 1e-9) and np.all(np.array(q) <= np.minimum(1, want * math.exp(0.02) + 1e-9) + 1e-9)
    assert false_discovery(df.limit(0), "s", 0).collect() == []
    inf = spark.createDataFrame([(0, float("inf"))], "i long, s double")
    assert false_discovery(inf, "s", 1).where(F.col("q") < 1e-300).count() == 1
