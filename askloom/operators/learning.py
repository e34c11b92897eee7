"""Models trained here: word vectors, co-occurrence factors, clusters, the post screen, principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, HashingTF, NGram, VectorAssembler, Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.operators.retrieval import norm


def word_vectors_train(df: DataFrame, tokens: str, dim: int = 100, window: int = 10, min_count: int = 5, rate: float = 0.025, epochs: int = 5, seed: int = 3, partitions: int | None = None) -> Word2VecModel:
    """Skip-gram vectors by Spark's implementation: no subwords, hierarchical softmax. The corpus is trained in
    `partitions` parts at once, as many as there are cores by default, whose vectors are averaged after each epoch."""
    partitions = partitions or df.sparkSession.sparkContext.defaultParallelism
    model = Word2Vec(numPartitions=partitions, vectorSize=dim, windowSize=window, minCount=min_count, stepSize=rate, maxIter=epochs, seed=seed, inputCol=tokens, outputCol="vec")
    return model.fit(df)


def word_table(model: Word2VecModel) -> DataFrame:
    """(token, vec array<float>)."""
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector", "float32").alias("vec"))


def unit(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def document_vectors(tokens: DataFrame, words: DataFrame, dim: int, unknown: Column | None = None) -> DataFrame:
    """(doc, vec): mean of the unit vectors of a document's tokens (doc, token).

    Tokens outside the table are skipped, or count as `unknown` where that is given. Sums are kept per component, so
    no document's vectors are ever gathered.
    """
    known = words.select("token", unit(F.col("vec")).alias("u"))
    joined = tokens.join(known, "token", "left" if unknown is not None else "inner")
    u = F.coalesce("u", unit(unknown)) if unknown is not None else F.col("u")
    means = [F.avg(F.get(u, i)).alias(f"c{i}") for i in range(dim)]
    return joined.groupBy("doc").agg(*means).select("doc", F.array(*[f"c{i}" for i in range(dim)]).alias("vec"))


def cooccurrence(tokens: DataFrame, window: int = 10) -> DataFrame:
    """(a, b, x) with a < b or a = b: weights 1/distance of word pairs at most `window` apart in (doc, ws array).

    Each position meets the next `window` positions of its own array: no join, and a long text costs its length.
    """
    ahead = F.transform(
        "ws", lambda w, i: F.transform(F.slice("ws", i + 2, F.lit(window)), lambda v, j: F.struct(F.least(w, v).alias("a"), F.greatest(w, v).alias("b"), (F.lit(1.0) / (j + 1)).alias("x")))
    )
    return tokens.select(F.explode(F.flatten(ahead)).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.x").alias("x"))


def glove_train(tokens: DataFrame, dim: int = 50, window: int = 10, min_count: int = 5, rounds: int = 10, seed: int = 3) -> DataFrame:
    """(token, vec): factors of log co-occurrence by alternating least squares; the mean vector is `<unk>`."""
    counts = tokens.select(F.explode("ws").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    from askloom.operators.relational import number_rows

    ids = number_rows(counts, [F.desc("n"), F.col("token")]).select("token", F.col("row").cast("int").alias("i"))
    pairs = cooccurrence(tokens, window)
    coded = pairs.join(ids.select(F.col("token").alias("a"), F.col("i").alias("ia")), "a").join(ids.select(F.col("token").alias("b"), F.col("i").alias("ib")), "b")
    both = coded.select("ia", "ib", "x").unionAll(coded.where("ia <> ib").select("ib", "ia", "x")).toDF("ia", "ib", "x").withColumn("y", F.log1p("x").cast("float"))
    model = ALS(rank=dim, maxIter=rounds, userCol="ia", itemCol="ib", ratingCol="y", seed=seed, coldStartStrategy="drop").fit(both)
    vecs = model.userFactors.join(ids, F.col("id") == F.col("i")).select("token", F.col("features").alias("vec"))
    mean = vecs.agg(F.array(*[F.avg(F.get("vec", i)).cast("float") for i in range(dim)]).alias("vec"))
    return vecs.unionByName(mean.select(F.lit("<unk>").alias("token"), "vec"))


def cluster_train(df: DataFrame, vector: str, k: int, rounds: int = 20, seed: int = 3, algorithm: str = "simple") -> KMeansModel:
    """k-means over array vectors by Spark's parallel k-means (`simple`). `minibatch` is another function's, which has no
    Spark model: see minibatch_centres."""
    if algorithm != "simple":
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return KMeans(k=k, maxIter=rounds, seed=seed, featuresCol="x", predictionCol="cluster").fit(df.select(array_to_vector(vector).alias("x")))


def minibatch_centres(df: DataFrame, vector: str, k: int, rounds: int = 100, batch: int = 100, seed: int = 7) -> np.ndarray:
    """Centres of mini-batch k-means: k rows to start from, then `rounds` batches, each row pulling its nearest centre by
    one over the rows which that centre has seen. The method looks at no more than k + rounds * batch rows, so these, by
    hash, are what reaches the driver; a table of fewer rows is gone through again."""
    rows = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.lit(seed), vector)).limit(k + rounds * batch).select(vector).toPandas()[vector]
    x = np.array(rows.tolist(), dtype=np.float64)
    if len(x) < k:
        raise ValueError(f"{len(x)} vectors for {k} clusters")
    rng = np.random.default_rng(seed)
    centre, seen = x[:k].copy(), np.zeros(k)
    for r in range(rounds):
        at = (k + np.arange(r * batch, (r + 1) * batch)) % len(x) if k + rounds * batch > len(x) else np.arange(k + r * batch, k + (r + 1) * batch)
        part = x[rng.permutation(at)]
        near = ((centre**2).sum(1) - 2 * part @ centre.T).argmin(1)
        for c in range(k):
            mine = part[near == c]
            if len(mine):
                seen[c] += len(mine)
                centre[c] += (mine - centre[c]).sum(0) / seen[c]
    return centre


def nearest_centre(centre: np.ndarray, df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, cluster): the nearest centre of every vector of their length, smaller number first; others leave."""
    dim, half = centre.shape[1], (centre**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((half - 2 * v @ centre.T).argmin(1).astype(np.int32))], [key, "cluster"])

    usable = df.where((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull())).select(key, vector)
    return usable.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, cluster int")


def cluster_predict(model: KMeansModel, df: DataFrame, key: str, vector: str) -> DataFrame:
    return model.transform(df.select(key, array_to_vector(vector).alias("x"))).select(key, "cluster")


def principal_components(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    rows = df.select(key, array_to_vector(vector).alias("x"))
    return PCA(k=k, inputCol="x", outputCol="y").fit(rows).transform(rows).select(key, vector_to_array("y").alias("components"))


def screen_pipeline(features: int = 1 << 14, reg: float = 0.01, rounds: int = 25) -> Pipeline:
    """The post screen: hashed words and word pairs into a logistic regression (column `tokens` to `prediction`)."""
    return Pipeline(
        stages=[
            NGram(n=2, inputCol="tokens", outputCol="pairs"),
            HashingTF(numFeatures=features, inputCol="tokens", outputCol="f1"),
            HashingTF(numFeatures=features, inputCol="pairs", outputCol="f2"),
            VectorAssembler(inputCols=["f1", "f2"], outputCol="features"),
            LogisticRegression(regParam=reg, maxIter=rounds),
        ]
    )


def screen_train(labelled: DataFrame, **kw) -> PipelineModel:
    """`labelled` has tokens array<string> and label double."""
    return screen_pipeline(**kw).fit(labelled)


def screen_scores(predicted: DataFrame) -> dict[str, float]:
    e = MulticlassClassificationEvaluator()
    return {m: e.evaluate(predicted, {e.metricName: m}) for m in ("accuracy", "f1", "weightedPrecision", "weightedRecall")}


def screen_grid(labelled: DataFrame, regs: list[float], folds: int = 5, seed: int = 1200) -> CrossValidatorModel:
    """Cross-validated grid over the regularisation of the model screen_train fits; folds by hash of Id, so every label
    is spread evenly."""
    pipe = screen_pipeline()
    grid = ParamGridBuilder().addGrid(pipe.getStages()[-1].regParam, regs).build()
    fold = F.pmod(F.xxhash64("Id", F.lit(seed)), F.lit(folds)).cast("int")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, foldCol="fold", parallelism=2)
    from askloom.session import cut

    return cv.fit(cut(labelled.withColumn("fold", fold)))
