import json
import os

import pytest

from pyspark.sql import functions as F

from askloom import jobs
from askloom.operators.retrieval import SearchEngine

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_corpus_and_index(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"questions": f"{DATA}/questions.parquet", "answers": f"{DATA}/answers.parquet", "out": str(tmp_path / "out"), "index_conditions": ["Title NOT NULL"]}))
    c = jobs.Config.read(str(tmp_path / "p.json"))
    lines = jobs.corpus(spark, c)
    assert lines.count() > 0 and lines.where("line rlike '[<>]'").count() == 0
    c.models, c.vector_size, c.min_count, c.epochs = ["tfidf", "words", "glove"], 8, 2, 1
    found = jobs.index(spark, c).search("how to read", n=5)
    assert 0 < found.count() <= 5
    one, mixed = (SearchEngine.load(spark, f"{tmp_path}/out/index", m, f) for m, f in ((["tfidf"], ["Title"]), (["tfidf", "words"], None)))
    assert list(one.spaces) == ["tfidf"] and list(one.spaces["tfidf"][1]) == ["Title"] and len(mixed.spaces["words"][1]) == 2
    text = spark.read.parquet(c.questions).where("Title is not null").first()["Title"]
    parts = [SearchEngine.load(spark, f"{tmp_path}/out/index", [m]).scores(text) for m in ("tfidf", "words")]
    want = parts[0].unionByName(parts[1]).groupBy("doc").agg(F.round(F.sum("sim"), 4).alias("s")).orderBy(F.desc("s"), "doc").first()
    assert mixed.search(text, n=1).first()["sim"] == want["s"] > 1
    weighed = mixed.search(text, n=3, weights={"Title": 0.6, "Body": 0.4}).collect()
    assert [r["rank"] for r in weighed] == [1, 2, 3]
    with pytest.raises(ValueError):
        SearchEngine.load(spark, f"{tmp_path}/out/index", ["none"])
    c.token_form = "stem"
    with pytest.raises(ValueError):
        jobs.corpus(spark, c)


def test_config(tmp_path):
    with pytest.raises(FileNotFoundError):
        jobs.Config.read(str(tmp_path / "none"))
    (tmp_path / "p.json").write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        jobs.Config.read(str(tmp_path / "p.json"))
