"""Vectorised tails and a distributed false-discovery adjustment."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG10 = math.log(10.0)


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0, by recurrence up to 8 and Stirling's series beyond; about 1e-13 relative."""
    x = np.asarray(x, dtype=np.float64)
    shift, z = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = z < 8
        if not low.any():
            break
        shift[low] += np.log(z[low])
        z[low] += 1
    r = 1.0 / (z * z)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def hypergeom_upper(k, K, n, N) -> np.ndarray:
    """-ln P(X >= k) for X hypergeometric: n draws from N of which K count. Exact: log-gamma for the first term,
    then the ratio of neighbouring terms; k at or below the smallest possible value gives 0."""
    k, K, n, N = (np.asarray(v, dtype=np.float64) for v in (k, K, n, N))
    k, K, n, N = (v.copy() for v in np.broadcast_arrays(k, K, n, N))
    out, top = np.zeros(k.shape), np.minimum(n, K)
    least = np.maximum(0, n + K - N)
    mean = np.where(N > 0, n * K / np.maximum(N, 1), 0)
    sure = (k <= least) | (k <= mean - 9 * np.sqrt(mean) - 30)
    out[k > top] = np.inf
    i = np.flatnonzero(~sure & (k <= top))
    if not len(i):
        return out
    kk, KK, nn, NN, tt = k[i], K[i], n[i], N[i], top[i]
    first = log_choose(KK, kk) + log_choose(NN - KK, nn - kk) - log_choose(NN, nn)
    total, term, j, alive = np.ones(len(i)), np.ones(len(i)), kk.copy(), np.arange(len(i))
    while len(alive):
        a = alive
        term[a] *= (KK[a] - j[a]) * (nn[a] - j[a]) / ((j[a] + 1) * (NN[a] - KK[a] - nn[a] + j[a] + 1))
        j[a] += 1
        total[a] += term[a]
        alive = a[(j[a] < tt[a]) & (term[a] > 1e-17 * total[a])]
    out[i] = np.maximum(0, -(first + np.log(total)))
    return out


_erfc = np.frompyfunc(math.erfc, 1, 1)


def log_normal_upper(w: np.ndarray) -> np.ndarray:
    """ln P(Z > w), with the asymptotic series far out."""
    near = np.minimum(w, 25.0)
    direct = np.log(np.maximum(0.5 * _erfc(near / math.sqrt(2)).astype(np.float64), 1e-300))
    far = np.maximum(w, 5.0)
    r = 1 / (far * far)
    series = -0.5 * far * far - np.log(far) - 0.5 * math.log(2 * math.pi) + np.log1p(-r * (1 - r * (3 - 15 * r)))
    return np.where(w > 20, series, direct)


def poisson_binomial_upper(c: np.ndarray, count: np.ndarray, p: np.ndarray) -> np.ndarray:
    """-ln P(X >= c) for X a sum of count[s] Bernoulli(p[r, s]) draws, s over classes, one row r per case.

    Saddlepoint (Lugannani-Rice with lattice correction): a few per cent in the far tail, at any number of draws.
    c <= 0 gives 0, c above the number of draws gives inf.
    """
    c = np.asarray(c, dtype=np.float64)
    p = np.clip(p, 0.0, 1 - 1e-12)
    mean, x = p @ count, c - 0.5
    t = np.log(np.maximum(x, 1e-9) / np.maximum(mean, 1e-300))
    for _ in range(60):
        e = p * np.exp(np.minimum(t, 700))[:, None]
        q = e / (1 - p + e)
        step = (q @ count - x) / np.maximum((q * (1 - q)) @ count, 1e-300)
        step = np.clip(step, -2, 2)
        t = t - step
        if np.max(np.abs(step), initial=0) < 1e-10:
            break
    e = p * np.exp(np.minimum(t, 700))[:, None]
    q = e / (1 - p + e)
    k0, k2 = np.log1p(p * np.expm1(np.minimum(t, 700))[:, None]) @ count, (q * (1 - q)) @ count
    w = np.sign(t) * np.sqrt(np.maximum(2 * (t * x - k0), 0))
    u = 2 * np.sinh(np.clip(t, -600, 600) / 2) * np.sqrt(k2)
    close = (np.abs(w) < 1e-4) | (np.abs(u) < 1e-8)
    ws, us = np.where(close, 1.0, w), np.where(close, 1.0, u)
    tail = log_normal_upper(ws)
    correction = -0.5 * ws * ws - 0.5 * math.log(2 * math.pi)
    rest = 1 / us - 1 / ws
    out = -(tail + np.log(np.maximum(1 + rest * np.exp(np.minimum(correction - tail, 700)), 1e-12)))
    out = np.where(close, math.log(2), out)
    out = np.where(c <= 0, 0.0, out)
    return np.maximum(np.where(c > count.sum(), np.inf, out), 0.0)


def false_discovery(df: DataFrame, score: str, tests, steps_per_unit: int = 50, most: int = 800) -> DataFrame:
    """Adds `q`, the Benjamini-Hochberg adjusted probability of rows whose `score` is -ln p, out of `tests` tests.

    No global sort: rows are counted per step of 1/steps_per_unit in -ln p - at most steps_per_unit * most + 1 rows,
    a fixed bound, so these go to one task and back by broadcast - and a row gets its step's value, at most
    exp(1/steps_per_unit) from the exact one and never below it.
    """
    step = steps_of(F.col(score), steps_per_unit, most)
    table = adjusted(df.select(step.alias("_step")).groupBy("_step").agg(F.count("*").alias("_n")), tests, steps_per_unit)
    return df.withColumn("_step", step).join(F.broadcast(table), "_step").drop("_step")


def steps_of(score: Column, steps_per_unit: int = 50, most: int = 800) -> Column:
    return F.least(F.floor(score * steps_per_unit), F.lit(steps_per_unit * most)).cast("int")


def adjusted(counts: DataFrame, tests, steps_per_unit: int = 50) -> DataFrame:
    """(_step, q) of (_step, _n), the number of rows of each step: q falls, or stays, from step to step."""
    down, up = Window.orderBy(F.desc("_step")), Window.orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    table = counts.withColumn("_rank", F.sum("_n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    worst = F.exp(-F.col("_step") / F.lit(float(steps_per_unit))) * tests / F.col("_rank")
    return table.withColumn("q", F.least(F.lit(1.0), F.min(worst).over(up))).select("_step", "q")
