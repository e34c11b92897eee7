import gc
import os
import random
import threading
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.llm.knn import most_similar, rotation
from askloom.llm.neardup import forest_pairs, near_duplicates, visible_words


def brute(rows, k, floor):
    ids = [i for i, _ in rows]
    m = np.array([v for _, v in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    out = set()
    for r, i in enumerate(ids):
        near = sorted((-s[r, c], ids[c]) for c in range(len(ids)) if c != r and s[r, c] >= floor)[:k]
        out |= {(i, j) for _, j in near}
    return out


@pytest.mark.parametrize("tile,per_list,lists,largest", [(8192, 4096, 8192, 65_536), (40, 64, 8192, 65_536), (40, 16, 3, 100)])
def test_most_similar_recall(spark, tile, per_list, lists, largest):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((40, 32))
    rows = [(i, (centre[i % 40] + 0.35 * rng.standard_normal(32)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(20)] + [(600, [2 * x for x in rows[5][1]])]
    bad = [(700, None), (701, []), (702, [0.0] * 32), (703, [1.0] * 5), (704, [float("nan")] * 32), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "k long, v array<float>").withColumn("id", F.lit("clash"))
    got = {(r["id"], r["other"]) for r in most_similar(df, "k", "v", 5, 0.8, tile=tile, per_list=per_list, most_lists=lists, largest=largest).collect()}
    want = brute(rows, 5, 0.8)
    assert len(got & want) / len(want) >= 0.98 and len(got - want) <= 0.02 * len(want)
    assert all(a != b for a, b in got)
    twins = {a: sorted(b for x, b in got if x == a) for a in (3, 500, 519)}
    assert twins[3] == [500, 501, 502, 503, 504] and twins[519] == [3, 500, 501, 502, 503] and twins[500] == [3, 501, 502, 503, 504]


def test_most_similar_edges(spark):
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "k long, v array<float>")
    assert most_similar(none, "k", "v").collect() == []
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "k long, v array<float>")
    assert most_similar(one, "k", "v", 5, 0.5).collect() == []
    r = rotation(8, 1)
    assert np.allclose(r @ r.T, np.eye(8), atol=1e-5)


def jaccard(a, b):
    x, y = Counter(a), Counter(b)
    shared = sum((x & y).values())
    return shared / max(1, sum(x.values()) + sum(y.values()) - shared)


def make(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(600)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(40, 120))]
        rows.append((10 * i, "t", " ".join(words)))
        for c in range(rng.choice([0, 0, 1, 3])):
            w = [rng.choice(vocab) if rng.random() < 0.08 else x for x in words]
            half = len(w) // 2
            rows.append((10 * i + c + 1, "t", " ".join(w[half:] + w[:half])))
    return rows


@pytest.mark.parametrize("tile", [4096, 3])
def test_near_duplicates_equal_brute_force(spark, tile):
    rows = make(150, 3)
    rows += [(5000 + i, rows[0][1], rows[0][2]) for i in range(4)] + [(6000, None, rows[1][2]), (6001, "x", None), (6002, None, ""), (6003, "", "<p></p>"), (6004, "same short", "one"), (6005, "same", "<b>short</b> one"), (None, "t", rows[0][2])]
    df = spark.createDataFrame(rows, "k long, t string, b string").withColumn("id", F.lit("clash"))
    got = [tuple(r)[:2] for r in near_duplicates(df, "k", "t", "b", 0.57, tile=tile).collect()]
    assert len(got) == len(set(got))
    words = [(i, visible_words(t, b)) for i, t, b in rows if i is not None and b is not None]
    want = {(min(i, j), max(i, j)) for x, (i, a) in enumerate(words) for j, b in words[x + 1 :] if a and b and jaccard(a, b) >= 0.57}
    assert set(got) == want


def test_forest_equals_all_pairs_it_may_keep():
    """Trees of every size at once: every pair of one tree above the threshold is there, and far fewer than all."""
    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 8, 9, 64, 65, 700]
    group = np.repeat(np.arange(len(sizes)), sizes)
    base = rng.random((40, 256)) < 0.3
    flags = base[rng.integers(0, 40, len(group))] ^ (rng.random((len(group), 256)) < 0.03)
    bits, size = np.packbits(flags, axis=1).view(np.uint64), flags.sum(1)
    shared = flags.astype(int) @ flags.T.astype(int)
    alike = (shared >= 0.57 * (size[:, None] + size[None, :] - shared)) & (group[:, None] == group[None, :])
    want = {(i, j) for i, j in zip(*np.nonzero(alike)) if i < j}
    got = [tuple(sorted(p)) for p in forest_pairs(group, bits, size, np.arange(len(group)), None, 0.57).tolist()]
    assert len(got) == len(set(got)) and set(got) == want
    side = rng.integers(0, 2, len(group))
    assert {tuple(sorted(p)) for p in forest_pairs(group, bits, size, size, side, 0.57).tolist()} == {(i, j) for i, j in want if side[i] != side[j]}
    assert len(forest_pairs(group[:0], bits[:0], size[:0], size[:0], None, 0.57)) == 0


def test_near_duplicates_of_many_copies(spark):
    text = " ".join(f"c{i}" for i in range(50))
    rows = [(i, text) for i in range(100)] + [(200 + i, text.replace("c7 ", "other ")) for i in range(100)] + [(900, text.replace("c9 ", ""))]
    got = {tuple(r)[:2]: r["kind"] for r in near_duplicates(spark.createDataFrame(rows, "k long, b string"), "k", None, "b", 0.57, expand=64).collect()}
    assert got[0, 1] == "member" and got[0, 200] == "classes"
    # beyond `expand`: representatives are linked, and every copy to its representative
    assert {(0, i) for i in range(1, 100)} | {(200, 200 + i) for i in range(1, 100)} | {(0, 200), (0, 900), (200, 900)} == set(got)
    assert near_duplicates(spark.createDataFrame([], "k long, b string"), "k", None, "b", 0.57).collect() == []


def edited(words, edits, rng, tag):
    w = list(words)
    for at in rng.sample(range(len(w)), edits):
        w[at] = f"{tag}x{at}"
    return w


def test_near_duplicates_beside_thousands_of_copies(spark):
    rng = random.Random(5)
    base = [f"c{i}" for i in range(100)]
    texts = {i: base for i in range(4000)} | {5000 + i: edited(base, 12, rng, f"e{i}") for i in range(12)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "k long, b string")
    got = {tuple(r)[:2] for r in near_duplicates(df, "k", None, "b", 0.57, expand=64).collect()}
    different = [0, *range(5000, 5012)]
    want = {(i, j) for x, i in enumerate(different) for j in different[x + 1 :] if jaccard(texts[i], texts[j]) >= 0.57}
    assert len(want) > 60 and want == {p for p in got if p[1] >= 5000}


def test_near_duplicates_of_a_large_group_of_edited_copies(spark):
    rng = random.Random(6)
    base = [f"c{i}" for i in range(100)]
    texts = [edited(base, rng.randrange(10, 14), rng, f"e{i}") for i in range(1000)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "k long, b string")
    got = near_duplicates(df, "k", None, "b", 0.57).toPandas()
    # edits are all different, so only places unedited in both are shared
    same = np.array([[w == b for w, b in zip(t, base)] for t in texts], dtype=np.float32)
    shared = same @ same.T
    want = np.triu(shared >= 0.57 * (200 - shared), 1)
    found = np.zeros_like(want)
    found[got["id_a"], got["id_b"]] = True
    assert len(got) == found.sum() and not (found & ~want).any()
    assert (found & want).sum() >= 0.999 * want.sum() > 400_000


def test_near_duplicates_in_another_order(spark):
    rng = random.Random(8)
    texts = {}
    for i in range(60):
        words = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(24, 90))]
        texts[2 * i] = words
        texts[2 * i + 1] = rng.sample(edited(words, 1, rng, "e"), len(words))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "k long, b string")
    got = {tuple(r)[:2] for r in near_duplicates(df, "k", None, "b", 0.57).collect()}
    assert got == {(i, i + 1) for i in range(0, 120, 2)}


def test_near_duplicates_hold_little_disk(spark):
    """Long texts of one vocabulary, of which many share an anchor: shuffle files never take twice the bags."""
    rng = np.random.default_rng(9)
    words = rng.choice(np.array([f"v{i}" for i in range(1500)]), (8000, 200))
    texts = [" ".join(w) for w in words] + [" ".join([*w[:190], "x"]) for w in words[:50]]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, b string").repartition(4).localCheckpoint()
    local = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def held():
        files = (os.path.join(d, f) for top in local for d, _, names in os.walk(top) for f in names if f.startswith("shuffle"))
        return sum(os.path.getsize(f) for f in files if os.path.exists(f))

    gc.collect()
    spark._jvm.System.gc()
    time.sleep(2)
    before, most, done = held(), [0], threading.Event()

    def watch():
        while not done.wait(0.1):
            most[0] = max(most[0], held() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = {tuple(r)[:2] for r in near_duplicates(df, "k", None, "b", 0.57).collect()}
    finally:
        done.set()
        watcher.join()
    assert got == {(i, 8000 + i) for i in range(50)}
    assert most[0] < 2 * 4 * 200 * len(texts), most[0]


def test_visible_words():
    assert visible_words("A b", "<p>See <a href='http://x/y'>it</a> <code>List&lt;T&gt;</code></p>") == ["a", "b", "see", "it", "list", "t"]
    assert visible_words(None, "&lt;p&gt;x &amp;lt;br&amp;gt;&lt;/p&gt;") == ["x", "br"]
    assert visible_words(None, "[a](http://x/y) `b` List<String> c") == ["a", "b", "list", "string", "c"]
    assert visible_words(None, "[[http://x/y|a b]] {{mono|f()}} [http://x/z c d]") == ["a", "b", "f", "c", "d"]
    assert visible_words(None, "\\href{http://x}{a} \\texttt{b} \\begin{minted}{java}\nc\n\\end{minted}") == ["a", "b", "c"]
