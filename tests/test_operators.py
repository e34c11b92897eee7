import math

import pytest
from pyspark.sql import functions as F

from askloom.operators import evaluation as E
from askloom.operators import learning as L
from askloom.operators import relational as R
from askloom.operators import retrieval as S
from askloom.sources import readers, writers
from askloom.streaming import clean_stream, post_stream, token_counts


def test_greedy_pairs_equals_the_fold(spark):
    import random

    rng = random.Random(4)
    pairs = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(40)})
    seen, kept = set(), []
    for s, d in pairs:
        if s not in seen:
            kept.append((s, d))
            seen |= {s, d}
    df = spark.createDataFrame([*pairs, (None, 1)], "a int, b int")
    assert sorted(map(tuple, R.greedy_pairs(df, "a", "b").collect())) == kept


def test_number_rows(spark):
    df = spark.range(1000).withColumn("x", F.pmod(F.col("id") * 7, F.lit(13))).repartition(7)
    got = R.number_rows(df, [F.desc("x"), F.col("id")]).orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(1, 1001))
    assert [(r["x"], r["id"]) for r in got] == sorted(((r["x"], r["id"]) for r in got), key=lambda p: (-p[0], p[1]))


def test_metrics(spark):
    rel = spark.createDataFrame([(q, r + 1, x) for q, xs in enumerate([[0] * 4, [1] * 4, [1, 0, 1, 0]]) for r, x in enumerate(xs)], "query_id int, rank int, rel int")
    ap = {r["query_id"]: r["ap"] for r in E.average_precision(rel, 4).collect()}
    assert ap[0] == 0 and ap[1] == 1 and ap[2] == pytest.approx((1 + 2 / 3) / 4)
    msl = {r["query_id"]: r["length"] for r in E.search_length(rel, 2, 20).collect()}
    assert msl == {0: 20, 1: 0, 2: 1}
    groups = E.equal_groups(spark.range(10), "id", 4).orderBy("id").collect()
    assert [r["grp"] for r in groups] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    empty = spark.createDataFrame([], "src long, dst long")
    assert E.hit_percentage(empty, empty).first()["percent"] is None


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 2.0])], "doc long, vec array<float>")
    sims = {(r["qid"], r["doc"]): r["sim"] for r in S.dense_scores(df.withColumnRenamed("doc", "qid"), df, None).collect()}
    assert sims[1, 1] == 1 and sims[1, 2] == 0 and sims[2, 2] == 0 and sims[1, 3] == pytest.approx(math.sqrt(0.5), abs=1e-6)
    top = S.dense_scores(df.withColumnRenamed("doc", "qid"), df, 1).collect()
    assert {(r["qid"], r["doc"]) for r in top} == {(1, 1), (2, 1), (3, 3)}
    with pytest.raises(ValueError):
        S.check_weights(["a", "b"], [0.5, 0.4])
    with pytest.raises(TypeError):
        S.check_weights(["a"], "x")
    assert S.parse_tags(" a, ,b ") == ["a", "b"] and S.parse_tags(" ") is None


def test_search_engine(spark):
    docs = spark.createDataFrame([(1, "read json file"), (2, "sort list"), (3, "json list parser")], "Id long, Title string")
    m = S.tfidf_train(docs, "Id", "Title")
    meta = spark.createDataFrame([(i, f"t{i}", ["x" if i < 3 else "y"], 1, f"Post: u/{i}\n##Score 3\ncode") for i in (1, 2, 3)], "PostId long, Title string, etags array<string>, SnippetCount int, Snippets string")
    engine = S.SearchEngine({"s": (m, {"Title": m.vectors(docs, "Id", "Title")})}, meta, "u/")
    assert [r["PostId"] for r in engine.search("json", n=5).orderBy("rank").collect()] == [3, 1] or [r["PostId"] for r in engine.search("json", n=5).orderBy("rank").collect()] == [1, 3]
    assert [r["PostId"] for r in engine.search("json", "y, none").collect()] == [3]
    assert engine.search("nothing").collect() == []


def test_learning_edges(spark):
    with pytest.raises(ValueError):
        L.cluster_train(spark.createDataFrame([([1.0],)], "v array<double>"), "v", 1, algorithm="other")
    words = spark.createDataFrame([("a", [3.0, 4.0]), ("z", [0.0, 0.0])], "token string, vec array<double>")
    toks = spark.createDataFrame([(1, "a"), (1, "q")], "doc long, token string")
    assert L.document_vectors(toks, words, 2).first()["vec"] == pytest.approx([0.6, 0.8])
    assert L.document_vectors(toks, words, 2, F.array(F.lit(0.0), F.lit(2.0))).first()["vec"] == pytest.approx([0.3, 0.9])


def test_files(spark, tmp_path):
    (tmp_path / "dump.xml").write_text('<r>\n <row Id="1" Score="2" Zzz="q"/>\n <row Id="2"/>\n <row Id="x"/>\n <row/>\n</r>')
    got = readers.xml_dump(spark, str(tmp_path / "dump.xml"), {"Id": "long", "Score": "int"}).orderBy("Id").collect()
    assert [tuple(r) for r in got] == [(1, 2), (2, None)]
    (tmp_path / "x.conll").write_text("a O\nb B\n\n\nc O\n")
    assert [len(r["items"]) for r in readers.conll(spark, str(tmp_path / "x.conll")).orderBy("sent").collect()] == [2, 1]
    (tmp_path / "bad.conll").write_text("a\n")
    with pytest.raises(Exception, match="too few fields"):
        readers.conll(spark, str(tmp_path / "bad.conll")).collect()
    (tmp_path / "w.vec").write_text("2 2\na 1 2\nb 3 4\n")
    assert {r["token"]: r["vec"] for r in readers.word_vectors(spark, str(tmp_path / "w.vec"), True).collect()} == {"a": [1, 2], "b": [3, 4], "<unk>": [2, 3]}
    (tmp_path / "l").write_text("1\n0\n")
    assert [r["label"] for r in readers.labels(spark, str(tmp_path / "l"), "bool").orderBy("pos").collect()] == [False, True]
    df = spark.createDataFrame([("a  b",), (None,)], "t string")
    writers.write_text(df.where("t is not null"), "t", str(tmp_path / "out"))
    assert [r[0] for r in readers.text_lines(spark, str(tmp_path / "out")).collect()] == ["a b"]


def test_streaming(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "see #a"), (2, "2024-01-01 00:20:00", "see b"), (3, "2024-01-01 01:10:00", None)]
    df = spark.createDataFrame(rows, "Id long, at string, Body string").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = post_stream(spark, str(tmp_path / "in"), df.schema)
    for name, out, mode in (("cleaned", clean_stream(stream, "Body"), "append"), ("counted", token_counts(stream, "Body", "at"), "complete")):
        q = out.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["Body"] for r in spark.table("cleaned").collect()) == ["see a", "see b"]
    assert {r["token"]: r["n"] for r in spark.table("counted").collect()}["see"] == 2


def test_grid_searches_the_model_that_is_trained(spark):
    from askloom.operators import learning as L

    rows = [(i, ["good", "text", f"w{i % 7}"] if i % 2 else ["bad", "code", f"w{i % 5}"], float(i % 2)) for i in range(60)]
    m = L.screen_grid(spark.createDataFrame(rows, "Id long, tokens array<string>, label double"), [0.01])
    trained = L.screen_pipeline().getStages()
    assert m.getNumFolds() == 5
    assert [s.getNumFeatures() for s in m.bestModel.stages[1:3]] == [s.getNumFeatures() for s in trained[1:3]]
    assert m.bestModel.stages[-1].getMaxIter() == trained[-1].getMaxIter()


def test_once_without_moving_texts(spark, tmp_path):
    from askloom.session import once_wide

    rows = [(1, "a"), (2, "b"), (1, "a"), (None, "c"), (3, None), (3, None), (3, None)]
    spark.createDataFrame(rows, "Id long, t string").repartition(3).write.parquet(f"{tmp_path}/x")
    for most in (10, 0):
        got = once_wide(spark.read.parquet(f"{tmp_path}/x"), "Id", most)
        assert got.columns == ["Id", "t"] and sorted(map(tuple, got.collect()), key=str) == [(1, "a"), (2, "b"), (3, None)]
    assert once_wide(spark.read.parquet(f"{tmp_path}/x").where("Id = 2").select("t", "Id")).collect() == [("b", 2)]


def test_dense_best_in_blocks_equals_brute_force(spark):
    import numpy as np

    import numpy as np

    rng = np.random.default_rng(4)
    a, b = (np.round(rng.standard_normal((60, 4)), 1) for _ in range(2))
    rows = [(i, a[i].tolist(), b[i].tolist() if i % 7 else None, [(int(q), 0.25) for q in range(0, 60, 5) if (q + i) % 3 == 0]) for i in range(60)]
    rows += [(100, [0.0] * 4, [1.0], None), (101, None, None, [])]
    docs = spark.createDataFrame(rows, "doc long, x array<double>, y array<double>, hits array<struct<q: long, h: double>>")
    asked = docs.where("doc % 5 = 0 and doc < 60").select(F.col("doc").alias("qid"), F.col("x").alias("vec"))
    metrics = {"x": [("x", None)], "both": [("x", None), ("y", None)], "hit": [("x", "h")]}

    def cos(u, v):
        size = np.linalg.norm(u) * np.linalg.norm(v)
        return round(float(u @ v / size), 6) if size else 0.0

    want = set()
    for q in range(0, 60, 5):
        sims = {"x": {}, "both": {}, "hit": {}}
        for doc, x, y, hits in rows:
            if x is None or doc == q:
                continue
            c = cos(a[q], np.array(x))
            sims["x"][doc] = c
            sims["hit"][doc] = round(c + dict(hits or []).get(q, 0.0), 6)
            if y is not None and len(y) == 4:
                sims["both"][doc] = (c + cos(a[q], np.array(y))) / 2
        want |= {(m, q, d) for m, s in sims.items() for d in sorted(s, key=lambda d: (-round(s[d] + 1e-12, 6), d))[:7]}
    for blocks in ({}, {"most_queries": 4, "shard": 20}):
        got = S.dense_best(asked, docs.repartition(3), metrics, 7, apart=True, **blocks).collect()
        assert {(r["metric"], r["qid"], r["doc"]) for r in got} == want and len(got) == len(want)
    above = S.dense_best(asked, docs, metrics, None, floor=0.9, most_queries=5, shard=30).collect()
    assert above and all(r["sim"] > 0.9 for r in above)
    assert S.dense_best(asked.limit(0), docs, metrics, 3).collect() == S.dense_best(asked, docs.limit(0), metrics, 3).collect() == []


def test_minibatch_centres(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, (np.array([10.0 * (i % 3), 5.0]) + 0.1 * rng.standard_normal(2)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows + [(900, None), (901, [1.0])], "id long, v array<double>")
    usable = df.where("size(v) = 2")
    centre = L.minibatch_centres(usable, "v", 3, rounds=20, batch=30)
    got = {r["id"]: r["cluster"] for r in L.nearest_centre(centre, df, "id", "v").collect()}
    assert len(got) == 300 and len(set(got.values())) >= 2
    assert all(len({got[i] for i in range(k, 300, 3)}) == 1 for k in range(3))
    with pytest.raises(ValueError):
        L.minibatch_centres(usable.limit(2), "v", 3)


def test_conll_in_splits(spark, tmp_path):
    from askloom.sources import readers as R

    text = "a O\nb O\n\nc O\n \nd O\n\n\n\ne O\n"
    (tmp_path / "x.conll").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8")
    try:
        got = R.conll(spark, str(tmp_path / "x.conll")).orderBy("sent").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [[x["token"] for x in r["items"]] for r in got] == [["a", "b"], ["c"], ["d"], ["e"]] and [r["sent"] for r in got] == [0, 1, 2, 3]


def test_hybrid_moves_no_pairs(spark, monkeypatch):
    """Sparse products are made where the documents are; a query without terms and a document without vectors count."""
    import numpy as np

    rng = np.random.default_rng(4)
    vec = lambda: [float(x) for x in rng.normal(size=3)]
    sparse = lambda: (lambda t: ([int(x) for x in t], [float(x) for x in rng.random(len(t))]))(rng.permutation(12)[: rng.integers(0, 6)])
    rows = [(i, vec() if i % 9 else None, *((None, None) if i % 7 == 0 else sparse())) for i in range(60)]
    asks = [(100 + i, vec(), *((None, None) if i == 3 else sparse())) for i in range(11)]
    docs = spark.createDataFrame(rows, "doc long, x array<double>, h_t array<long>, h_w array<double>")
    asked = spark.createDataFrame(asks, "qid long, vec array<double>, terms array<long>, weights array<double>")
    want = set()
    for q, v, qt, qw in asks:
        have = dict(zip(qt or [], qw or []))
        sims = [(-round(round(float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 6) + sum(have.get(a, 0.0) * b for a, b in zip(ht or [], hw or [])), 6), d) for d, x, ht, hw in rows if x]
        want |= {(q, d, -s) for s, d in sorted(sims)[:5]}
    for blocks in ({}, {"block": 4}, {"most_queries": 4, "shard": 25}):
        got = S.dense_best(asked, docs.repartition(3), {"m": [("x", "h")]}, 5, **blocks).collect()
        assert {(r["qid"], r["doc"], r["sim"]) for r in got} == want
    from askloom.plans.search import QUERIES

    monkeypatch.setattr(S, "sparse_scores", None)  # what joins queries and documents into pairs
    assert QUERIES["batch_hybrid_sims"](spark, "/root/testdata/sf0.01").count() == 180


def test_word_vectors_are_trained_whole(spark, monkeypatch):
    """fasttext_train has the original's size and epochs and trains on all cores at once."""
    from askloom.plans import learning as P

    made = []
    fit = L.Word2Vec.fit
    monkeypatch.setattr(L.Word2Vec, "fit", lambda self, df: made.append(self) or fit(self, df))
    monkeypatch.setattr(P, "corpus_words", lambda t: spark.createDataFrame([(i, ["read", "json", f"x{i % 3}"]) for i in range(30)], "Id long, ws array<string>"))
    got = P.QUERIES["fasttext_train"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 5 and all(len(r["vec"]) == 300 for r in got)
    (model,) = made
    assert (model.getMaxIter(), model.getWindowSize(), model.getMinCount()) == (24, 10, 5)
    assert model.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
