"""Batch jobs over an archive: select posts, build the corpus, train and index. Every stage is a table on disk."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions import html as H
from askloom.functions import text as X
from askloom.functions import tokens as T
from askloom.operators import learning as L
from askloom.operators import relational as R
from askloom.operators import retrieval as S
from askloom.session import cut
from askloom.sources import writers as W


@dataclass
class Config:
    """What a run depends on; read from JSON, unknown names raise."""

    questions: str = ""
    answers: str = ""
    out: str = ""
    tags: list[str] = field(default_factory=lambda: ["java", "swing"])
    not_tags: list[str] = field(default_factory=lambda: ["javascript"])
    conditions: list[str] = field(default_factory=lambda: ["AnswerCount >= 1", "Score >= -3"])
    index_conditions: list[str] = field(default_factory=lambda: ["AcceptedAnswerId NOT NULL", "Score >= 1", "SnippetCount >= 1"])
    keys: list[str] = field(default_factory=lambda: ["Title", "Body"])
    models: list[str] = field(default_factory=lambda: ["tfidf"])
    vector_size: int = 100
    window: int = 10
    min_count: int = 5
    epochs: int = 5
    token_form: str = "norm"
    base_url: str = "https://qa.example/questions/"

    @classmethod
    def read(cls, path: str) -> Config:
        if not Path(path).is_file():
            raise FileNotFoundError(path)
        values = json.loads(Path(path).read_text())
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        return cls(**values)


FORMS = {"norm": T.norm_text, "lemma": T.lemma_text}


def corpus(spark: SparkSession, c: Config) -> DataFrame:
    """(qid, part, at, line): cleaned titles, bodies and answers of the selected questions, written to out/corpus."""
    if c.token_form not in FORMS:
        raise ValueError(f"token_form is one of {sorted(FORMS)}")
    q = spark.read.parquet(c.questions).dropDuplicates(["Id"]).where(R.tag_filter(F.col("Tags"), c.tags, c.not_tags) & R.all_of(c.conditions))
    a = R.semi(spark.read.parquet(c.answers).dropDuplicates(["Id"]), "ParentId", q.select("Id"))
    lines = q.select(F.col("Id").alias("qid"), F.lit(0).alias("part"), F.col("Id").alias("at"), F.col("Title").alias("line"))
    lines = lines.unionByName(q.select(F.col("Id").alias("qid"), F.lit(1).alias("part"), F.col("Id").alias("at"), H.replace_pre(F.col("Body")).alias("line")))
    lines = lines.unionByName(a.select(F.col("ParentId").alias("qid"), F.lit(2).alias("part"), F.col("Id").alias("at"), H.replace_pre(F.col("Body")).alias("line")))
    formed = lines.where("line is not null").withColumn("line", X.strip_whitespace(X.strip_separators(F.col("line")))).where(X.keeps_quality(F.col("line")))
    cleaned = X.remove_long_packages(X.remove_binary_strings(X.remove_stack_traces(F.col("line"))))
    done = formed.withColumn("line", X.normalize_text(FORMS[c.token_form](cleaned)))
    W.write_table(done, f"{c.out}/corpus")
    return spark.read.parquet(f"{c.out}/corpus")


MODELS = ("tfidf", "words", "glove")


def index(spark: SparkSession, c: Config) -> S.SearchEngine:
    """Trains every model of `models` on the texts of all keys, and saves the vectors of every key and the metadata in
    out/index: `tfidf` is sparse, `words` (skip-gram) and `glove` (co-occurrence factors) are dense. Returns it loaded."""
    unknown = set(c.models) - set(MODELS)
    if unknown or not c.models:
        raise ValueError(f"models are among {MODELS}")
    q = spark.read.parquet(c.questions).dropDuplicates(["Id"]).where(R.all_of(c.index_conditions))
    parts = [q.select(F.lit(k).alias("key"), "Id", F.lower(X.normalize_text(H.html_text(F.col(k)))).alias("text")) for k in c.keys]
    texts = cut(reduce(DataFrame.unionByName, parts).where("text is not null"))
    tokens = texts.select(F.col("Id").alias("doc"), F.split(F.trim("text"), r"\s+").alias("ws")).where("ws[0] <> ''")

    def model(name: str) -> S.TfIdf | S.WordSpace:
        if name == "tfidf":
            return S.tfidf_train(texts, "Id", "text")
        if name == "words":
            return S.WordSpace(L.word_table(L.word_vectors_train(tokens, "ws", c.vector_size, c.window, c.min_count, epochs=c.epochs)), c.vector_size)
        words = cut(L.glove_train(tokens, c.vector_size, c.window, c.min_count, c.epochs))
        mean = words.where("token = '<unk>'").first()
        return S.WordSpace(words, c.vector_size, [float(x) for x in mean["vec"]] if mean else None)

    spaces = {}
    for name in c.models:
        m = model(name)
        spaces[name] = (m, {k: m.vectors(texts.where(F.col("key") == k), "Id", "text") for k in c.keys})
    tags = F.regexp_extract_all(F.lower(F.coalesce("Tags", F.lit(""))), F.lit("([a-z0-9][a-z0-9.#+-]*)"), F.lit(1))
    ents = F.filter(F.split(F.lower(F.coalesce("Entities", F.lit(""))), "<_ent_>"), lambda x: x != "")
    meta = q.select(F.col("Id").alias("PostId"), "Title", F.array_sort(F.array_union(tags, ents)).alias("etags"), "SnippetCount", "Snippets")
    S.SearchEngine(spaces, meta, c.base_url).save(f"{c.out}/index")
    return S.SearchEngine.load(spark, f"{c.out}/index")
