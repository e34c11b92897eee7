"""Sparse and dense document vectors, and ranked search over them.

A vector space is either sparse - rows (doc, term, w), unit length per doc, an inverted index once grouped by term -
or dense - rows (doc, vec). Ranking adds the similarities of several spaces and fields, filters by tags before the
cut, and keeps the best n with the smaller id first among equals.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom.session import cut


def tfidf_tokens(c: Column) -> Column:
    """Lower-case runs of at least two characters that are no white space."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([^ \t\n\r\f\x0B]{2,})"), F.lit(1))


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


@dataclass
class TfIdf:
    """term, df and idf of a fitted collection; idf = ln((1 + N) / (1 + df)) + 1."""

    vocabulary: DataFrame
    documents: int
    stop_words: list[str] = field(default_factory=list)
    trained: DataFrame | None = None

    def counts(self, df: DataFrame, key: str, text: str) -> DataFrame:
        tokens = df.select(F.col(key).alias("doc"), F.explode(tfidf_tokens(F.col(text))).alias("term"))
        if self.stop_words:
            tokens = tokens.where(~F.col("term").isin(self.stop_words))
        return tokens.groupBy("doc", "term").agg(F.count("*").alias("tf"))

    def weighed(self, counts: DataFrame) -> DataFrame:
        """(doc, term, w) of (doc, term, tf), each document of length 1. Terms outside the vocabulary carry nothing."""
        raw = counts.join(self.vocabulary.select("term", "idf"), "term").withColumn("x", F.col("tf") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc")))
        return raw.select("doc", "term", (F.col("x") / norm).alias("w"))

    def vectors(self, df: DataFrame, key: str, text: str) -> DataFrame:
        return self.weighed(self.counts(df, key, text))

    def own_vectors(self) -> DataFrame:
        """Vectors of the documents the model was trained on, whose counts are kept: their texts are not read again."""
        return self.weighed(self.trained)


def tfidf_train(df: DataFrame, key: str, text: str, stop_words: Sequence[str] | None = None) -> TfIdf:
    """Texts are read once: the counts of a document's terms are kept, document frequencies are added up from them."""
    stops = list(english_stop_words() if stop_words is None else stop_words)
    model = TfIdf(df, 0, stops)
    n = df.count()
    model.trained = cut(model.counts(df, key, text))
    dfreq = model.trained.groupBy("term").agg(F.count("*").alias("df"))
    model.vocabulary, model.documents = cut(dfreq.withColumn("idf", F.log(F.lit(1.0 + n) / (F.col("df") + 1.0)) + 1.0)), n
    return model


@dataclass
class WordSpace:
    """Word vectors (token, vec) of `dim` numbers; a text is the mean of the unit vectors of its words. Words that are not
    in the table are skipped, or count as `unknown` where that is given."""

    words: DataFrame
    dim: int
    unknown: list[float] | None = None

    def vectors(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(doc, vec). A text without known words has no row."""
        from askloom.operators.learning import document_vectors

        tokens = df.select(F.col(key).alias("doc"), F.explode(F.split(F.trim(F.lower(F.col(text))), r"\s+")).alias("token")).where("token <> ''")
        unknown = F.array(*map(F.lit, self.unknown)) if self.unknown else None
        return document_vectors(tokens, self.words, self.dim, unknown)


def sparse_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc, sim) of (qid, term, qw) and (doc, term, w): an equi-join on the term, so a document which shares no
    term with a query is never touched."""
    return queries.join(docs, "term").groupBy("qid", "doc").agg(F.sum(F.col("qw") * F.col("w")).alias("sim"))


def best(scores: DataFrame, n: int, by: Sequence[str] = ("qid",), sim: str = "sim", ident: str = "doc") -> DataFrame:
    """Rows with rank 1..n per `by`, ties to the smaller id. Window group limits cut every partition down first."""
    w = Window.partitionBy(*by).orderBy(F.desc(sim), ident)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(n == 0, F.lit(1.0)).otherwise(n))


def _half_away(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded like SQL rounds: halves go away from zero."""
    scale = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * scale + 0.5), x) / scale


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Unit vectors, a row each; zero where a vector is all zero, NaN where it is null, of another length or has nulls."""
    out = np.full((len(col), dim), np.nan)
    ok = pc.fill_null(pc.equal(pc.list_value_length(col), dim), False).to_numpy(zero_copy_only=False)
    if ok.any():
        v = pc.list_flatten(col.filter(pa.array(ok))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        out[ok] = np.divide(v, size, out=np.where(np.isnan(size), np.nan, 0.0) * np.ones_like(v), where=size > 0)
    return out


def _flat(terms: pa.Array | pa.ChunkedArray, weights: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors, two lists a row, as (row, term, weight)."""
    size = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(size)), size), pc.list_flatten(terms).to_numpy(zero_copy_only=False), pc.list_flatten(weights).to_numpy(zero_copy_only=False)


def _by_term(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct terms, where each begins (and the end), rows and weights in that order."""
    order = np.argsort(term, kind="stable")
    terms, start = np.unique(term[order], return_index=True)
    return terms, np.r_[start, len(order)], row[order], weight[order]


class _Kernel:
    """Scores one block of queries against batches of documents and holds the best of every metric and query."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, sparse: tuple[np.ndarray, ...] | None, metrics: dict, n: int | None, floor: float | None, apart: bool, digits: int):
        self.qids, self.q, self.metrics, self.n, self.floor, self.apart, self.digits = qids, q, metrics, n, floor, apart, digits
        self.sparse = sparse and _by_term(*sparse)
        self.held = {m: (np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64)) for m in metrics}
        self.place = {int(x): i for i, x in enumerate(qids)}

    def _hits(self, col, names: set) -> dict[str, np.ndarray]:
        """Per field of the hits (q, fields..): a matrix of queries and documents with what the hits add."""
        out = {f: np.zeros((len(self.qids), len(col))) for f in names}
        row = np.repeat(np.arange(len(col)), pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))
        flat = pc.list_flatten(col)
        if len(flat):
            at = np.array([self.place.get(x, -1) for x in pc.struct_field(flat, "q").to_pylist()])
            for f in names:
                value = pc.fill_null(pc.struct_field(flat, f), 0.0).to_numpy(zero_copy_only=False)
                out[f][at[at >= 0], row[at >= 0]] = value[at >= 0]
        return out

    def _products(self, t: pa.RecordBatch | pa.Table, names: set) -> dict[str, np.ndarray]:
        """The same matrices from sparse vectors, (name_t, name_w) of the documents, term by term: only queries and
        documents that have the term are touched."""
        terms, start, row, weight = self.sparse
        out = {f: np.zeros((len(self.qids), len(t))) for f in names}
        for f in names:
            found, begin, doc, w = _by_term(*_flat(t[f"{f}_t"], t[f"{f}_w"]))
            both, mine, theirs = np.intersect1d(terms, found, assume_unique=True, return_indices=True)
            for i, j in zip(mine, theirs):
                a, b = slice(start[i], start[i + 1]), slice(begin[j], begin[j + 1])
                out[f][row[a, None], doc[b]] += weight[a, None] * w[b]
        return out

    def _cut(self, at, sim, doc):
        order = np.lexsort((doc, -sim, at))
        at, sim, doc = at[order], sim[order], doc[order]
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
        keep = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)])) < self.n
        return at[keep], sim[keep], doc[keep]

    def take(self, t: pa.RecordBatch | pa.Table) -> list[pa.RecordBatch]:
        ids, done = t["doc"].to_numpy(zero_copy_only=False), []
        fields = {f for parts in self.metrics.values() for f, _ in parts}
        cos = {f: _half_away(self.q @ _matrix(t[f], self.q.shape[1]).T, self.digits) for f in fields}
        extra = {h for parts in self.metrics.values() for _, h in parts if h}
        hits = {} if not extra else self._hits(t["hits"], extra) if self.sparse is None else self._products(t, extra)
        for m, parts in self.metrics.items():
            s = sum(cos[f] + (hits[h] if h else 0.0) for f, h in parts)
            s = s if len(parts) == 1 and not extra else _half_away(s / len(parts), self.digits)
            keep = ~np.isnan(s)
            if self.apart:
                keep &= self.qids[:, None] != ids[None, :]
            if self.floor is not None:
                keep &= s > self.floor
            if self.n is not None and s.shape[1] > self.n:
                ranked = np.where(keep, s, -np.inf)
                keep &= s >= np.partition(ranked, -self.n, axis=1)[:, -self.n][:, None]
            a, d = np.nonzero(keep)
            found = (a, s[a, d], ids[d])
            if self.n is None:
                done.append(self._rows(m, *found))
            else:
                self.held[m] = self._cut(*(np.concatenate(x) for x in zip(self.held[m], found)))
        return done

    def _rows(self, m, at, sim, doc) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m] * len(at), pa.string()), pa.array(self.qids[at]), pa.array(doc), pa.array(sim)], ["metric", "qid", "doc", "sim"])

    def rest(self) -> list[pa.RecordBatch]:
        return [] if self.n is None else [self._rows(m, *x) for m, x in self.held.items()]


def dense_best(
    queries: DataFrame,
    docs: DataFrame,
    metrics: Mapping[str, Sequence[tuple[str, str | None]]],
    n: int | None,
    floor: float | None = None,
    apart: bool = False,
    digits: int = 6,
    most_queries: int = 2048,
    shard: int = 65_536,
    block: int = 2048,
) -> DataFrame:
    """(metric, qid, doc, sim) of queries (qid, vec) against all documents (doc, vectors.., hits), integer ids.

    metrics: name -> parts, each a vector column of the documents and, or None, a field of `hits`; the similarity is the
    mean over the parts of the cosine, rounded to `digits`, plus what the document's hits, an array of structs (q,
    fields..), say of the query; rounded again. Vectors that are null, of another length than the queries', or hold
    nulls give a document no similarity in the metrics that need them; all-zero vectors have cosine 0. `floor` drops
    similarities not above it, `apart` a query's own id. With `n` the n best of every metric and query come out, smaller
    ids first among equals: every task holds and sends on no more than n of each.

    Instead of `hits`, documents may have sparse vectors (name_t array of term numbers, name_w array of weights) for the
    names the metrics use, and the queries (terms, weights) of their own: what is added is their product.

    All vectors of a document are read once, for all metrics. Up to `most_queries` queries travel to the documents by
    broadcast and meet them in blocks of `block`. More are cut into blocks, documents into shards of about `shard`, and
    each block meets each shard in a task of its own: nothing of it passes the driver.
    """
    metrics = {m: list(parts) for m, parts in metrics.items()}
    qid, doc = dict(queries.dtypes)["qid"], dict(docs.dtypes)["doc"]
    schema = f"metric string, qid {qid}, doc {doc}, sim double"
    both = ["terms", "weights"] if "terms" in queries.columns else []
    queries = cut(queries.select("qid", "vec", *both).where("qid is not null and size(vec) > 0"))
    total = queries.count()
    if not total:
        return docs.sparkSession.createDataFrame([], schema)
    make = (metrics, n, floor, apart, digits)
    if total <= most_queries:
        rows = queries.toPandas()
        parts = [rows[i : i + block].reset_index(drop=True) for i in range(0, total, block)]
        wide = len(rows["vec"][0])
        shared = docs.sparkSession.sparkContext.broadcast([
            (x["qid"].to_numpy(), _matrix(pa.array(x["vec"].tolist(), pa.list_(pa.float64())), wide), _flat(pa.array(x["terms"].tolist(), pa.list_(pa.int64())), pa.array(x["weights"].tolist(), pa.list_(pa.float64()))) if both else None)
            for x in parts
        ])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kernels = [_Kernel(*x, *make) for x in shared.value]
            for batch in batches:
                for s in range(0, len(batch), block):
                    for kernel in kernels:
                        yield from kernel.take(batch.slice(s, block))
            for kernel in kernels:
                yield from kernel.rest()

        out = docs.mapInArrow(score, schema)
    else:
        blocks, shards = -(-total // most_queries), max(1, -(-docs.count() // shard))

        def meet(q: pa.Table, d: pa.Table) -> pa.Table:
            if not len(q) or not len(d):
                return pa.table({"metric": pa.array([], pa.string()), "qid": q["qid"].slice(0, 0), "doc": d["doc"].slice(0, 0), "sim": pa.array([], pa.float64())})
            kernel = _Kernel(q["qid"].to_numpy(), _matrix(q["vec"], len(q["vec"][0])), _flat(q["terms"], q["weights"]) if both else None, *make)
            got = [b for s in range(0, len(d), 8192) for b in kernel.take(d.slice(s, 8192))]
            return pa.Table.from_batches(got + kernel.rest())

        left = queries.select("qid", "vec", *both, F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_d"))
        right = docs.withColumn("_d", F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        out = left.groupBy("_q", "_d").cogroup(right.groupBy("_q", "_d")).applyInArrow(meet, schema)
    return out if n is None else best(out, n, ("metric", "qid")).drop("rank")


def dense_scores(queries: DataFrame, docs: DataFrame, n: int | None, floor: float | None = None, digits: int = 6) -> DataFrame:
    """(qid, doc, sim) of (qid, vec) against all of (doc, vec); see dense_best."""
    return dense_best(queries, docs.select("doc", "vec"), {"": [("vec", None)]}, n, floor, digits=digits).drop("metric")


def check_weights(fields: Sequence[str], weights: Mapping[str, float] | Sequence[float] | None) -> dict[str, float]:
    """Weights by field; none means a plain sum. Their number must be that of the fields and their sum 1."""
    if weights is None:
        return dict.fromkeys(fields, 1.0)
    if not isinstance(weights, Mapping):
        if isinstance(weights, (str, bytes)) or not isinstance(weights, Sequence):
            raise TypeError("weights must be a sequence or a mapping")
        if len(weights) != len(fields):
            raise ValueError(f"{len(fields)} fields, {len(weights)} weights")
        weights = dict(zip(fields, weights))
    if set(weights) != set(fields):
        raise ValueError(f"weights for {sorted(weights)}, fields are {sorted(fields)}")
    if abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    return dict(weights)


def parse_tags(text: str | None) -> list[str] | None:
    """Comma-separated tags of a query, blanks removed; none if nothing is left."""
    tags = [t for t in (text or "").replace(" ", "").split(",") if t]
    return tags or None


class SearchEngine:
    """Ranked search over questions: any mix of sparse and dense spaces, each over several fields, with metadata for
    presentation. Similarities of all spaces and fields are added up, so a sparse and a dense space make a hybrid.

    spaces: name -> (TfIdf, {field: (doc, term, w) rows}) or (WordSpace, {field: (doc, vec) rows}). metadata: PostId,
    Title, etags, SnippetCount, Snippets.
    """

    def __init__(self, spaces: Mapping[str, tuple[TfIdf | WordSpace, Mapping[str, DataFrame]]], metadata: DataFrame, base: str):
        self.spaces, self.metadata, self.base = spaces, metadata, base

    def infer(self, text: str, space: str) -> DataFrame:
        """The query's vector: (qid, term, qw) in a sparse space, (qid, vec) in a dense one."""
        model, _ = self.spaces[space]
        one = self.metadata.sparkSession.createDataFrame([(0, text.strip().lower())], "doc long, text string")
        found = model.vectors(one, "doc", "text").withColumnRenamed("doc", "qid")
        return found.withColumnRenamed("w", "qw") if isinstance(model, TfIdf) else found

    def scores(self, text: str, weights=None) -> DataFrame:
        """(doc, sim): what every space and field adds, one row each. Of a sparse space only the query's terms are read,
        by a filter which reaches the files; a dense one is a single pass of JVM arithmetic."""
        parts = []
        for name, (model, fields) in self.spaces.items():
            by = check_weights(list(fields), weights)
            query = cut(self.infer(text, name))  # the vector of one short text
            if isinstance(model, TfIdf):
                terms = [r["term"] for r in query.select("term").collect()]
                parts += [sparse_scores(F.broadcast(query), v.where(F.col("term").isin(terms))).select("doc", (F.col("sim") * by[f]).alias("sim")) for f, v in fields.items()]
                continue
            row = query.first()
            for f, v in fields.items():
                sim = cosine(F.array(*map(F.lit, row["vec"])), F.col("vec")) if row else F.lit(0.0)
                parts.append(v.select("doc", (sim * by[f]).alias("sim")).where("sim <> 0"))
        return reduce(DataFrame.unionByName, parts)

    def search(self, text: str, tags: str | Sequence[str] | None = None, n: int = 20, weights=None, rank=None, then=None) -> DataFrame:
        """(rank, PostId, Title, SnippetCount, anslink, score, snippet, sim, link). `rank` replaces the ranking of
        the summed similarities (doc, sim), `then` gets the result; both are plain functions of a DataFrame."""
        wanted = parse_tags(tags) if isinstance(tags, str) else list(tags) if tags else None
        docs = self.metadata.select(F.col("PostId").alias("doc"), "etags")
        if wanted:
            docs = docs.where(F.arrays_overlap("etags", F.array(*map(F.lit, wanted))))
        total = self.scores(text, weights).groupBy("doc").agg(F.round(F.sum("sim"), 6).alias("sim")).join(docs, "doc", "left_semi")
        top = rank(total, n) if rank else total.orderBy(F.desc("sim"), "doc").limit(n)
        out = metadata_frame(top, self.metadata, self.base)
        return then(out) if then else out

    def save(self, path: str) -> None:
        """The index as Parquet below `path`: vectors of a sparse space by ranges of terms, so that a query reads the
        row groups of its terms; models and metadata beside them."""
        spark = self.metadata.sparkSession
        about = []
        for name, (model, fields) in self.spaces.items():
            sparse = isinstance(model, TfIdf)
            (model.vocabulary if sparse else model.words).write.mode("overwrite").parquet(f"{path}/{name}/model")
            for f, v in fields.items():
                laid = v.repartitionByRange("term").sortWithinPartitions("term", "doc") if sparse else v
                laid.write.mode("overwrite").parquet(f"{path}/{name}/{f}")
                kept = dict(documents=model.documents, stop_words=model.stop_words) if sparse else dict(dim=model.dim, unknown=model.unknown)
                about.append((name, f, json.dumps(kept)))
        self.metadata.write.mode("overwrite").parquet(f"{path}/metadata")
        spark.createDataFrame([(*row, self.base) for row in about], "space string, field string, kept string, base string").coalesce(1).write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str, spaces: Sequence[str] | None = None, fields: Sequence[str] | None = None) -> SearchEngine:
        """A saved index, all of it or some spaces and fields; nothing is trained or read before a search."""
        about = spark.read.json(f"{path}/about").collect()  # a row for each space and field
        found: dict = {}
        for row in sorted(about, key=lambda r: (r["space"], r["field"])):
            if (spaces is not None and row["space"] not in spaces) or (fields is not None and row["field"] not in fields):
                continue
            kept, model = json.loads(row["kept"]), spark.read.parquet(f"{path}/{row['space']}/model")
            made = TfIdf(model, **kept) if "documents" in kept else WordSpace(model, **kept)
            found.setdefault(row["space"], (made, {}))[1][row["field"]] = spark.read.parquet(f"{path}/{row['space']}/{row['field']}")
        missing = set(spaces or ()) - set(found) | set(fields or ()) - {f for _, by in found.values() for f in by}
        if missing or not found:
            raise ValueError(f"{path} holds no {sorted(missing) or 'index'}")
        return cls(found, spark.read.parquet(f"{path}/metadata"), about[0]["base"])


def metadata_frame(top: DataFrame, metadata: DataFrame, base: str) -> DataFrame:
    """Presentation rows of the few ranked (doc, sim): they are the broadcast side, n rows."""
    from askloom.functions.text import parse_snippet

    ranked = top.select(F.row_number().over(Window.orderBy(F.desc("sim"), "doc")).alias("rank"), "doc", F.round("sim", 4).alias("sim"))
    rows = metadata.join(F.broadcast(ranked), F.col("PostId") == F.col("doc"))
    first = F.split("Snippets", "<_post_>")[0]
    return rows.select("rank", "PostId", "Title", "SnippetCount", parse_snippet(first).alias("s"), "sim", F.concat(F.lit(base), F.col("PostId").cast("string")).alias("link")).select(
        "rank", "PostId", "Title", "SnippetCount", "s.anslink", "s.score", "s.snippet", "sim", "link"
    )
