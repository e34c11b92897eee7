import collections
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.llm import distinctive
from askloom.llm.cooccur import fit_configuration, least_surprise, pair_surprise
from askloom.llm.distinctive import distinctive_terms, top_terms
from askloom.llm.queries import p5_found
from askloom.llm.stats import hypergeom_upper
from askloom.llm.topn import top_n


def test_pair_counts_and_surprise(spark):
    rng = random.Random(2)
    rows = [sorted({rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5))}) for _ in range(300)] + [["x", "y"]] * 12
    df = spark.createDataFrame([(r + [None] * (i % 2) + r[:1],) for i, r in enumerate(rows)] + [(None,), ([],), ([None],)], "tags array<string>").withColumn("item_a", F.lit(1))
    got = {(r["item_a"], r["item_b"]): r for r in pair_surprise(df, "tags").collect()}
    want = collections.Counter((a, b) for r in rows for i, a in enumerate(r) for b in r[i + 1 :])
    assert {k: v["together"] for k, v in got.items()} == dict(want)
    assert all(r["baskets"] == len(rows) for r in got.values())
    best = max(got.values(), key=lambda r: r["surprise"])
    assert (best["item_a"], best["item_b"]) == ("x", "y") and best["q"] < 1e-3 and best["lift"] > 3
    assert pair_surprise(df.limit(0), "tags").collect() == []
    assert pair_surprise(spark.createDataFrame([(["a"],)], "tags array<string>"), "tags").collect() == []


def test_surprise_chooses_and_loses_no_pair(spark):
    """Baskets of uneven size: all pairs of a lift of 3 or more come out, and some of the others do not."""
    rng = random.Random(9)
    items = [f"i{k}" for k in range(60)]
    rows = [(sorted(set(rng.choices(items, [1 / (k + 1) for k in range(60)], k=rng.choice((1, 2, 2, 3, 8))))),) for _ in range(500)]
    df = spark.createDataFrame(rows, "tags array<string>")
    every, some = (pair_surprise(df, "tags", lift).toPandas() for lift in (None, 3.0))
    high = every[every["together"] * every["baskets"] >= 3 * every["n_a"] * every["n_b"]]
    assert set(map(tuple, high[["item_a", "item_b"]].values)) <= set(map(tuple, some[["item_a", "item_b"]].values))
    assert 0 < len(high) and len(some) < 0.8 * len(every)
    assert least_surprise(np.ones(1), np.array([10.0]), np.ones(3), 3.0) > 0.9 and least_surprise(np.zeros(0), np.zeros(0), np.zeros(0), 3.0) == 0


def test_configuration_meets_degrees():
    sizes, ns, freqs, nf = np.array([1.0, 2, 5]), np.array([40.0, 30, 10]), np.array([5.0, 30]), np.array([12.0, 3])
    x, y = fit_configuration(sizes, ns, freqs, nf)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p @ nf, sizes, rtol=1e-4) and np.allclose(ns @ p, freqs, rtol=1e-4)


def test_terms(spark):
    rows = [(1, "The cat cat", "the"), (2, None, "the dog"), (3, None, None), (4, "", "it"), (5, "the " * 4000, "zebra")]
    df = spark.createDataFrame(rows, "Id long, Title string, Body string").withColumn("term", F.lit("clash"))
    out, n = distinctive_terms(df, "Id", ["Title", "Body"])
    got = {(r["id"], r["term"]): r for r in out.collect()}
    assert n == 5 and {k: v["tf"] for k, v in got.items()} == {(1, "the"): 2, (1, "cat"): 2, (2, "the"): 1, (2, "dog"): 1, (5, "the"): 4000, (5, "zebra"): 1}
    r = got[1, "cat"]
    assert (r["df"], r["cf"], r["length"]) == (1, 2, 4) and r["score"] == pytest.approx(-math.log(4 * 3 / (4007 * 4006)), abs=1e-6)
    split, _ = distinctive_terms(df, "Id", ["Title", "Body"], adjust=False, heavy=2)  # nearly all terms by the join
    assert {(x["id"], x["term"]): x["score"] for x in split.collect()} == {k: v["score"] for k, v in got.items()}
    assert distinctive_terms(df.limit(0), "Id", ["Title"])[0].collect() == []


@pytest.mark.parametrize("giant", [0, 20_000])
def test_top_terms_equal_brute_force(spark, giant):
    """Every case comes out, with its adjusted probability, also beside a record that holds most of all words."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(400)]
    texts = {i: [vocab[min(int(rng.expovariate(0.02)), 399)] for _ in range(rng.randrange(1, 60))] for i in range(200)}
    if giant:
        texts[900] = [rng.choice(vocab) for _ in range(giant)] + ["only", "here"]
    out = top_terms(spark.createDataFrame([(i, " ".join(w), None) for i, w in texts.items()], "k long, a string, b string"), "k", ["a", "b"], 5)
    got = {r["id"]: r for r in out.collect()}
    tf = {i: Counter(w) for i, w in texts.items()}
    df, cf = Counter(t for c in tf.values() for t in c), Counter(t for w in texts.values() for t in w)
    best = {i: min((-n * math.log(len(texts) / df[t]), t) for t, n in c.items())[1] for i, c in tf.items()}
    assert {i: r["term"] for i, r in got.items()} == {i: t for i, t in best.items() if df[t] <= 5} and len(got) > 5
    keys = [(i, t) for i, c in tf.items() for t in c]
    score = hypergeom_upper(*zip(*((tf[i][t], cf[t], len(texts[i]), cf.total()) for i, t in keys)))
    order = np.argsort(-score)
    q = np.minimum(1, np.minimum.accumulate((np.exp(-score[order]) * len(keys) / np.arange(1, len(keys) + 1))[::-1])[::-1])
    exact = dict(zip([keys[k] for k in order], q))
    assert all(exact[i, r["term"]] * (1 - 1e-6) <= r["q"] <= exact[i, r["term"]] * math.exp(1 / 50) * (1 + 1e-6) for i, r in got.items())


def test_top_terms_of_few_records(spark):
    one = spark.createDataFrame([(1, "bbb aaa bbb")], "k long, a string")
    assert [tuple(r)[:4] for r in top_terms(one, "k", ["a"], 5).collect()] == [(1, "aaa", 1, 1)]
    assert top_terms(one.limit(0), "k", ["a"], 5).collect() == []
    many = spark.createDataFrame([(i, "aaa") for i in range(6)], "k long, a string")
    assert top_terms(many, "k", ["a"], 5).collect() == []


def test_found_terms_are_adjusted_candidates(spark, tmp_path, monkeypatch):
    """Without adjusted probabilities no term is a candidate."""
    rows = [(i, f"title{'abcdefgh'[i]}", "the text of all") for i in range(8)]
    spark.createDataFrame(rows, "Id long, Title string, Body string").write.parquet(f"{tmp_path}/questions.parquet")
    assert p5_found(spark, str(tmp_path)).count() == 8
    real = distinctive.adjusted
    monkeypatch.setattr(distinctive, "adjusted", lambda *a: real(*a).where("false"))
    assert p5_found(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("bits,hot", [(1, 0.001), (3, 0.2), (8, 0.001)])
def test_top_n_equals_sorting(spark, bits, hot):
    rng = random.Random(bits)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, None]), i, rng.choice([None, -5, 0, 0, 0, 1, 1, 2, 2**31 - 1])) for i in range(400)]
    rows += rows[:30] + [(9, None, 1), (7, 1000, None), (8, -3, -(2**31)), (8, -4, None)]
    df = spark.createDataFrame(rows, "p long, i long, s int").withColumn("code", F.lit("x")).repartition(5)
    got = sorted((r["group_key"], r["item_id"], r["score"] if r["score"] is not None else "-") for r in top_n(df, "p", "s", "i", 3, bits, hot).collect())
    want = []
    for g in {r[0] for r in rows if r[0] is not None}:
        mine = sorted({r for r in rows if r[0] == g and r[1] is not None}, key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        want += [(g, i, s if s is not None else "-") for _, i, s in mine[:3]]
    assert got == sorted(want, key=lambda r: r[:2])


def test_top_n_empty(spark):
    assert top_n(spark.createDataFrame([], "p long, i long, s int"), "p", "s", "i", 3).collect() == []


def test_top_n_of_fractions(spark):
    df = spark.createDataFrame([("a", 1, "1.25"), ("a", 2, "1.5"), ("a", 3, "1.26"), ("a", 4, None), ("b", 5, "-0.75")], "g string, i long, s string")
    got = top_n(df.withColumn("s", F.col("s").cast("decimal(6,2)")), "g", "s", "i", 2).collect()
    assert sorted((r["group_key"], r["item_id"], str(r["score"])) for r in got) == [("a", 2, "1.50"), ("a", 3, "1.26"), ("b", 5, "-0.75")]
    with pytest.raises(TypeError):
        top_n(df.withColumn("s", F.col("s").cast("double")), "g", "s", "i", 2)
