"""Items that appear together: exact pair counts against a fitted bipartite configuration null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.stats import false_discovery, poisson_binomial_upper
from askloom.session import cut


def _classes(degrees: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(degree, how many) of a (degree, many) table. Distinct degrees number at most sqrt(2 * all incidences), so this
    table is small whatever the data: 150,000 rows at ten thousand million incidences."""
    got = degrees.orderBy("degree").toPandas()
    return got["degree"].to_numpy(float), got["many"].to_numpy(float)


def _sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cells: int = 4_000_000) -> np.ndarray:
    """For each x: the sum over y of weight * y / (1 + x * y), block by block."""
    step = max(1, cells // max(len(y), 1))
    return np.concatenate([(weight * y / (1 + np.outer(x[i : i + step], y))).sum(1) for i in range(0, len(x), step)])


def fit_configuration(sizes, n_sizes, freqs, n_freqs, rounds: int = 500, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Fugacities x, y with link probability x*y/(1+x*y), so that expected basket sizes and item frequencies are
    those observed. Alternating fixed point; all links are equivalent within a class of equal degrees."""
    links = (sizes * n_sizes).sum()
    if not len(sizes) or links == 0:
        return np.zeros(len(sizes)), np.zeros(len(freqs))
    x, y = sizes / np.sqrt(links), freqs / np.sqrt(links)
    for _ in range(rounds):
        x1 = np.minimum(sizes / np.maximum(_sums(x, y, n_freqs), 1e-300), 1e12)
        y1 = np.minimum(freqs / np.maximum(_sums(y, x1, n_sizes), 1e-300), 1e12)
        moved = max(np.abs(x1 / x - 1).max(), np.abs(y1 / y - 1).max())
        x, y = x1, y1
        if moved < tol:
            break
    return x, y


def least_surprise(x: np.ndarray, n_x: np.ndarray, y: np.ndarray, lift: float, cells: int = 4_000_000) -> float:
    """What the surprise of a pair is at least, if it is together `lift` times as often as independence gives.

    By Markov's inequality P(X >= c) is at most expected / c. With p the link probabilities of an item over n baskets,
    n * sum(p * q) <= r * sum(p) * sum(q) for two items, where r is the largest n * sum(p^2) / sum(p)^2 of any item
    (Cauchy-Schwarz), and sum(p) is the item's frequency. So P is at most r / lift. A tenth is taken off for the
    saddlepoint and the fit."""
    if not len(x) or not len(y) or lift <= 0:
        return 0.0
    r, step = 1.0, max(1, cells // len(x))
    for i in range(0, len(y), step):
        p = np.outer(y[i : i + step], x)
        p /= 1 + p
        r = max(r, (n_x.sum() * (p * p @ n_x) / np.maximum(p @ n_x, 1e-300) ** 2).max())
    return max(0.0, -0.9 * np.log(r / lift) - 0.01)


def pair_surprise(df: DataFrame, basket: str, lift: float | None = None, cells: int = 2_000_000) -> DataFrame:
    """(item_a, item_b, together, n_a, n_b, baskets, expected, lift, surprise, q), item_a < item_b.

    `basket` is an array column, one record per row; an item counts once per record, null items and null or empty
    baskets leave, a basket of one item counts for frequencies alone. `together` is exact. `expected` and
    `surprise` = -ln P(X >= together) come from the bipartite configuration null that honours every item's frequency
    and every basket's size: X is Poisson-binomial over the baskets, grouped by size. `q` adjusts for all pairs of
    items, also those never seen together. An empty table gives an empty result; other columns are not read.
    With `lift` only pairs come out which surprise enough to be together `lift` times as often as independence gives
    (see least_surprise): all that are, and of the others those above the same bound; q still counts every pair.

    Pairs leave a record one by one and are added up in each partition before the shuffle, whose rows are distinct
    pairs. Only the degree tables reach the driver (see _classes).
    """
    records = df.select(F.array_sort(F.array_distinct(F.filter(basket, lambda v: v.isNotNull()))).alias("b")).where(F.size("b") > 0)
    single = records.select(F.explode("b").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    single = cut(single)
    sizes = records.groupBy(F.size("b").alias("degree")).agg(F.count("*").alias("many"))
    s, ns = _classes(sizes)
    f, nf = _classes(single.groupBy(F.col("n").alias("degree")).agg(F.count("*").alias("many")))
    x, y = fit_configuration(s, ns, f, nf)
    baskets, items = int(ns.sum()), int(nf.sum())

    left = records.select("b", F.posexplode("b").alias("at", "item_a")).where(F.col("at") + 1 < F.size("b"))
    pairs = left.select("item_a", F.explode(F.slice("b", F.col("at") + 2, F.size("b"))).alias("item_b"))
    pairs = pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("together"))
    pairs = pairs.join(single.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a")
    pairs = pairs.join(single.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            step = max(1, cells // max(len(x), 1))
            for start in range(0, len(b), step):
                part = b.iloc[start : start + step].copy()
                ya, yb = (y[np.searchsorted(f, part[c].to_numpy(float))] for c in ("n_a", "n_b"))
                xa, xb = np.outer(ya, x), np.outer(yb, x)
                p = xa / (1 + xa) * (xb / (1 + xb))
                part["expected"] = p @ ns
                part["surprise"] = poisson_binomial_upper(part["together"].to_numpy(float), ns, p)
                yield part

    kind = dict(single.dtypes)["item"]
    scored = pairs.select("item_a", "item_b", "together", "n_a", "n_b").mapInPandas(
        run, f"item_a {kind}, item_b {kind}, together long, n_a long, n_b long, expected double, surprise double"
    )
    scored = scored.withColumn("baskets", F.lit(baskets).cast("long")).withColumn("lift", F.col("together") / F.col("expected"))
    scored = false_discovery(cut(scored), "surprise", items * (items - 1) / 2)
    return scored if lift is None else scored.where(F.col("surprise") >= least_surprise(x, ns, y, lift))
