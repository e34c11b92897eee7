"""Queries of trained models and of vector means."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from askloom.functions.html import html_text
from askloom.functions.text import clean_corpus, line_quality, normalize_text
from askloom.operators import learning as L
from askloom.operators import relational as R
from askloom.plans.base import Part, Tables
from askloom.plans.search import dense
from askloom.plans.tokens import _WORDS, words
from askloom.session import kept

P = Part()


def titles(t: Tables) -> DataFrame:
    return words(t).select("Id", F.transform("ws", lambda w: F.lower(w)).alias("ws"))


def title_words(t: Tables) -> DataFrame:
    return titles(t).select(F.col("Id").alias("doc"), F.explode("ws").alias("token"))


def corpus_words(t: Tables) -> DataFrame:
    """(Id, ws): words of the whole corpus, one row per title, question body and answer body."""
    q, a = t.q("Title", "Body"), t.a("Body")
    texts = q.select("Id", F.col("Title").alias("x")).unionByName(q.select("Id", F.col("Body").alias("x"))).unionByName(a.select("Id", F.col("Body").alias("x")))
    clean = F.trim(F.lower(normalize_text(clean_corpus(html_text(F.col("x"))))))
    return texts.where("x is not null").select("Id", F.split(clean, r"\s+").alias("ws")).where("ws[0] <> ''")


@P.add("fasttext_train")
def fasttext_train(t: Tables) -> DataFrame:
    """Vectors of the original's size: 300 numbers, ten words to each side, 24 epochs over the whole corpus. It is parsed
    once, not in every epoch."""
    return L.word_table(L.word_vectors_train(kept(corpus_words(t), "corpus"), "ws", dim=300, window=10, min_count=5, epochs=24))


@P.add("glove_cooccurrence", f"WITH w AS ({_WORDS}), k AS (SELECT Id, unnest(list_transform(ws, lambda x: lower(x))) AS token, generate_subscripts(ws, 1) AS pos FROM w) SELECT least(x.token, y.token) AS a, greatest(x.token, y.token) AS b, round(sum(1.0::DOUBLE / (y.pos - x.pos)), 6) AS x FROM k x JOIN k y ON x.Id = y.Id AND y.pos > x.pos AND y.pos <= x.pos + 10 GROUP BY 1, 2", "q")
def glove_cooccurrence(t: Tables) -> DataFrame:
    return L.cooccurrence(titles(t)).select("a", "b", F.round("x", 6).alias("x"))


@P.add("glove_train")
def glove_train(t: Tables) -> DataFrame:
    return L.glove_train(corpus_words(t), dim=8, min_count=3, rounds=3)


#: Word vectors by table: the embeddings, given to the words of titles in alphabetical order.
_VECTORS = "x AS (SELECT token, row_number() OVER (ORDER BY token) AS r FROM (SELECT DISTINCT token FROM k)), t AS (SELECT token, embedding::DOUBLE[] AS vec FROM x JOIN (SELECT DISTINCT ON (vec_id) * FROM embeddings) e ON e.vec_id = r - 1)"


def tabled_vectors(t: Tables) -> DataFrame:
    """(token, vec): of words beyond the number of embeddings there is none."""
    words_ = R.number_rows(title_words(t).select("token").distinct(), [F.col("token")]).select("token", (F.col("row") - 1).alias("vec_id"))
    return words_.join(t.raw("embeddings").dropDuplicates(["vec_id"]).select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("token", "vec")


def _mean_sql(join: str, vec: str) -> str:
    k = f"WITH w AS ({_WORDS}), k AS (SELECT Id, unnest(list_transform(ws, lambda x: lower(x))) AS token FROM w), {_VECTORS}"
    unit = "n AS (SELECT Id, list_transform(vec, lambda z: z / s) AS u FROM (SELECT Id, vec, sqrt(list_sum(list_transform(vec, lambda z: z * z))) AS s FROM j))"
    return f"{k}, j AS (SELECT Id, {vec} AS vec FROM k {join} JOIN t USING (token)), {unit}, p AS (SELECT Id, unnest(u) AS x, generate_subscripts(u, 1) - 1 AS i FROM n) SELECT Id AS doc, i, round(avg(x), 6) + 0.0 AS value FROM p GROUP BY ALL"


def _components(df: DataFrame) -> DataFrame:
    return df.select("doc", F.posexplode("vec").alias("i", "value")).select("doc", F.col("i").cast("long").alias("i"), (F.round("value", 6) + 0.0).alias("value"))


def _size(t: Tables) -> int:
    return t.raw("embeddings").agg(F.max(F.size("embedding"))).first()[0]


@P.add("vector_mean", _mean_sql("", "vec"), "q")
def vector_mean(t: Tables) -> DataFrame:
    """The mean of the unit vectors of a title's known words, a row for each number."""
    return _components(L.document_vectors(title_words(t), tabled_vectors(t), _size(t)))


@P.add("fasttext_vectors", _mean_sql("", "vec"), "q")
def fasttext_vectors(t: Tables) -> DataFrame:
    """The same vectors by the dense space of the search engine, from texts."""
    from askloom.operators.retrieval import WordSpace

    texts = titles(t).select("Id", F.array_join("ws", " ").alias("text"))
    return _components(WordSpace(tabled_vectors(t), _size(t)).vectors(texts, "Id", "text"))


@P.add("glove_vectors", _mean_sql("LEFT", "coalesce(vec, (SELECT list_transform(embedding, lambda z: 1.0::DOUBLE) FROM embeddings LIMIT 1))"), "q")
def glove_vectors(t: Tables) -> DataFrame:
    """Unknown words count as one vector of their own, here all ones."""
    dim = _size(t)
    return _components(L.document_vectors(title_words(t), tabled_vectors(t), dim, F.array(*[F.lit(1.0)] * dim)))


@P.add("embed_cluster_train")
def embed_cluster_train(t: Tables) -> DataFrame:
    model = L.cluster_train(dense(t, "TitleV"), "vec", 10)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return t.spark.createDataFrame(rows, "cluster int, centre array<double>")


@P.add("embed_cluster_predict")
def embed_cluster_predict(t: Tables) -> DataFrame:
    d = dense(t, "TitleV")
    return L.cluster_predict(L.cluster_train(d, "vec", 10), d, "doc", "vec")


@P.add("embed_cluster_minibatch")
def embed_cluster_minibatch(t: Tables) -> DataFrame:
    """Clusters by mini-batches, predicted for every vector."""
    d = dense(t, "TitleV")
    return L.nearest_centre(L.minibatch_centres(d, "vec", 10), d, "doc", "vec")


@P.add("cluster_members", "WITH x AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM (SELECT DISTINCT vec_id, label FROM embeddings) QUALIFY n <= 20) SELECT label, string_agg(vec_id, ' ' ORDER BY vec_id) AS members FROM x GROUP BY label")
def cluster_members(t: Tables) -> DataFrame:
    """The first 20 members of every cluster; window group limits keep big clusters off one task."""
    rows = t.raw("embeddings").select("vec_id", "label").distinct()
    few = rows.withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("at <= 20")
    return few.groupBy("label").agg(F.concat_ws(" ", F.sort_array(F.collect_list("vec_id")).cast("array<string>")).alias("members"))


@P.add("pca")
def pca(t: Tables) -> DataFrame:
    return L.principal_components(dense(t, "TitleV"), "doc", "vec", 8)


def labelled(t: Tables) -> DataFrame:
    """(Id, tokens, label): answers; unclean are those with much punctuation for their words."""
    from askloom.functions.tokens import post_tokens

    rows = t.a("Body").where("Body is not null")
    return rows.select("Id", post_tokens(F.col("Body")).alias("tokens"), (line_quality(F.col("Body")) < 1.6).cast("double").alias("label"))


#: Rows by hash of the id: a fixed quarter is held out.
def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    cell = F.pmod(F.xxhash64("Id"), F.lit(4))
    return rows.where(cell != 0), rows.where(cell == 0)


@P.add("classifier_model")
@P.add("classifier_train")
def classifier_train(t: Tables) -> DataFrame:
    model = L.screen_train(_split(labelled(t))[0])
    top = model.stages[-1]
    rows = [(top.numFeatures, float(top.intercept), int(top.coefficients.numNonzeros()))]
    return t.spark.createDataFrame(rows, "features int, intercept double, used int")


@P.add("classifier_predict")
def classifier_predict(t: Tables) -> DataFrame:
    train, held = _split(labelled(t))
    return L.screen_train(train).transform(held).select("Id", "label", "prediction")


@P.add("filter_posts_classifier")
def filter_posts_classifier(t: Tables) -> DataFrame:
    rows = labelled(t)
    return L.screen_train(_split(rows)[0]).transform(rows).where("prediction = 0").select("Id")


@P.add("classifier_eval")
def classifier_eval(t: Tables) -> DataFrame:
    train, held = _split(labelled(t))
    scores = L.screen_scores(L.screen_train(train).transform(held))
    return t.spark.createDataFrame(sorted(scores.items()), "metric string, value double")


@P.add("classifier_grid")
def classifier_grid(t: Tables) -> DataFrame:
    regs = [0.001, 0.1]
    m = L.screen_grid(labelled(t), regs)
    return t.spark.createDataFrame([(r, float(a), float(s)) for r, a, s in zip(regs, m.avgMetrics, m.stdMetrics)], "reg double, accuracy double, std double")


QUERIES, SQL = P.QUERIES, P.SQL
