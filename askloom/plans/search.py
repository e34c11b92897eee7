"""Queries of vector spaces, ranking, search and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.operators import evaluation as E
from askloom.operators import relational as R
from askloom.operators import retrieval as S
from askloom.plans.base import Part, Tables, code_parts_sql
from askloom.plans.relational import lookup, snippets_of
from askloom.session import cut, kept

P = Part()
_STOPS = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ("the", "an", "to", "of", "and", "in", "on", "is", "my", "our", "how", "with", "this", "that", "for", "from")) + ")"
_STOP_LIST = [w.strip("'") for w in _STOPS[1:-1].split(", ")]
#: Search texts and where they look; a query table in use.
_QUERIES = [(1, "read a file with json parser"), (2, "sort list of dates"), (3, "swing button listener event"), (4, "connection pool exception")]


def _space(field: str, p: str) -> str:
    """SQL of a TF-IDF space of q.<field>, CTE names prefixed by p."""
    return rf"""{p}k AS (SELECT Id AS doc, unnest(regexp_extract_all(lower({field}), '[^ \t\n\r\f\x0B]{{2,}}')) AS term FROM q WHERE {field} IS NOT NULL),
    {p}c AS (SELECT doc, term, count(*) AS tf FROM {p}k WHERE term NOT IN {_STOPS} GROUP BY ALL),
    {p}n AS (SELECT count(*)::DOUBLE AS n FROM q WHERE {field} IS NOT NULL),
    {p}i AS (SELECT term, count(*) AS df, ln((1 + (SELECT n FROM {p}n)) / (1.0 + count(*))) + 1 AS idf FROM {p}c GROUP BY term),
    {p}x AS (SELECT doc, term, tf * idf AS x FROM {p}c JOIN {p}i USING (term)),
    {p}w AS (SELECT doc, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS w FROM {p}x)"""


def _queries(p: str) -> str:
    rows = ", ".join(f"({i}, '{s}')" for i, s in _QUERIES)
    return rf"""{p}qk AS (SELECT qid, unnest(regexp_extract_all(lower(s), '[^ \t\n\r\f\x0B]{{2,}}')) AS term FROM (VALUES {rows}) v(qid, s)),
    {p}qc AS (SELECT qid, term, count(*) AS tf FROM {p}qk WHERE term NOT IN {_STOPS} GROUP BY ALL),
    {p}qx AS (SELECT qid, term, tf * idf AS x FROM {p}qc JOIN {p}i USING (term)),
    {p}qw AS (SELECT qid, term, x / sqrt(sum(x * x) OVER (PARTITION BY qid)) AS qw FROM {p}qx),
    {p}s AS (SELECT qid, doc, sum(qw * w) AS sim FROM {p}qw JOIN {p}w USING (term) GROUP BY qid, doc)"""


def model(t: Tables, field: str) -> tuple[S.TfIdf, DataFrame]:
    docs = t.q(field).where(F.col(field).isNotNull())
    return S.tfidf_train(docs, "Id", field, _STOP_LIST), docs


def query_rows(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(_QUERIES, "qid int, text string")


def query_vectors(t: Tables, m: S.TfIdf) -> DataFrame:
    return m.vectors(query_rows(t), "qid", "text").select(F.col("doc").alias("qid"), "term", F.col("w").alias("qw"))


def field_scores(t: Tables, field: str) -> DataFrame:
    m = model(t, field)[0]
    return S.sparse_scores(F.broadcast(query_vectors(t, m)), m.own_vectors())  # four short queries


@P.add("tok_tfidf", r"SELECT Id, array_to_string(regexp_extract_all(lower(Title), '[^ \t\n\r\f\x0B]{2,}'), ' ') AS tokens FROM q WHERE Title IS NOT NULL", "q")
def tok_tfidf(t: Tables) -> DataFrame:
    return t.q("Title").where("Title is not null").select("Id", F.array_join(S.tfidf_tokens(F.col("Title")), " ").alias("tokens"))


@P.add("tfidf_train", f"WITH {_space('Title', 't')} SELECT term, df, round(idf, 6) AS idf FROM ti", "q")
def tfidf_train(t: Tables) -> DataFrame:
    return model(t, "Title")[0].vocabulary.select("term", "df", F.round("idf", 6).alias("idf"))


@P.add("tfidf_vectors", f"WITH {_space('Title', 't')} SELECT doc, term, round(w, 6) AS w FROM tw", "q")
def tfidf_vectors(t: Tables) -> DataFrame:
    return model(t, "Title")[0].own_vectors().select("doc", "term", F.round("w", 6).alias("w"))


def indexed(t: Tables, fields: tuple[str, ...] = ("Title", "Body")) -> S.SearchEngine:
    """A search engine over one sparse space for each field."""
    spaces = {}
    for f in fields:
        m = model(t, f)[0]
        spaces[f.lower()] = (m, {f: m.own_vectors()})
    return S.SearchEngine(spaces, metadata(t), "https://qa.example/questions/")


@P.add("build_search_index", f"WITH {_space('Title', 't')}, {_space('Body', 'b')} SELECT 'Title' AS field, doc, term, round(w, 6) AS w FROM tw UNION ALL SELECT 'Body', doc, term, round(w, 6) FROM bw", "q")
def build_search_index(t: Tables) -> DataFrame:
    """The vectors of every field, as an index holds them."""
    rows = [v.select(F.lit(f).alias("field"), "doc", "term", F.round("w", 6).alias("w")) for _, fields in indexed(t).spaces.values() for f, v in fields.items()]
    return rows[0].unionByName(rows[1])


@P.add("query_vector", f"WITH {_space('Title', 't')}, {_queries('t')} SELECT qid, term, round(qw, 6) AS qw FROM tqw", "q")
def query_vector(t: Tables) -> DataFrame:
    return query_vectors(t, model(t, "Title")[0]).select("qid", "term", F.round("qw", 6).alias("qw"))


_RANK = "row_number() OVER (PARTITION BY qid ORDER BY sim DESC, doc) AS rank"


@P.add("rank_topk", f"WITH {_space('Title', 't')}, {_queries('t')}, r AS (SELECT qid, doc, round(sim, 6) AS sim FROM ts) SELECT qid, doc, sim, {_RANK} FROM r QUALIFY rank <= 20", "q")
def rank_topk(t: Tables) -> DataFrame:
    return S.best(field_scores(t, "Title").withColumn("sim", F.round("sim", 6)), 20)


_BOTH = f"WITH {_space('Title', 't')}, {_queries('t')}, {_space('Body', 'b')}, {_queries('b')}"


@P.add("rank_single", _BOTH + f", r AS (SELECT qid, doc, round(sum(sim), 6) AS sim FROM (SELECT qid, doc, 0.6 * sim AS sim FROM ts UNION ALL SELECT qid, doc, 0.4 * sim FROM bs) GROUP BY qid, doc) SELECT qid, doc, sim, {_RANK} FROM r QUALIFY rank <= 20", "q")
def rank_single(t: Tables) -> DataFrame:
    weights = S.check_weights(["Title", "Body"], [0.6, 0.4])
    parts = [field_scores(t, f).select("qid", "doc", (F.col("sim") * w).alias("sim")) for f, w in weights.items()]
    total = parts[0].unionByName(parts[1]).groupBy("qid", "doc").agg(F.round(F.sum("sim"), 6).alias("sim"))
    return S.best(total, 20)


# dense vectors

_DENSE = "SELECT PostId AS doc, {f}::DOUBLE[] AS vec FROM v WHERE len({f}) = 128"
_COS = "CASE WHEN list_sum(list_transform(x.vec, lambda z: z * z)) = 0 OR list_sum(list_transform(y.vec, lambda z: z * z)) = 0 THEN 0 ELSE list_cosine_similarity(x.vec, y.vec) END"
_ASK = "PostId % 50 = 0"


def dense(t: Tables, field: str) -> DataFrame:
    return t.v(field).where(F.size(field) == 128).select(F.col("PostId").alias("doc"), F.col(field).alias("vec"))


def asked(t: Tables, field: str) -> DataFrame:
    """The stated query set of searches: rows whose id divides by 50."""
    return dense(t, field).where("doc % 50 = 0").select(F.col("doc").alias("qid"), "vec")


def _dense_sql(q: str, d: str) -> str:
    return f"SELECT x.doc AS qid, y.doc, round({_COS}, 6) AS sim FROM {q} x, {d} y WHERE x.doc % 50 = 0"


_SPACES = f"tv AS ({_DENSE.format(f='TitleV')}), bv AS ({_DENSE.format(f='BodyV')}), tt AS ({_dense_sql('tv', 'tv')}), tb AS ({_dense_sql('tv', 'bv')}), m AS (SELECT qid, doc, round((tt.sim + tb.sim) / 2, 6) AS sim FROM tt JOIN tb USING (qid, doc)), every AS (SELECT 'title' AS metric, * FROM tt UNION ALL SELECT 'body', * FROM tb UNION ALL SELECT 'title-body', * FROM m)"


_METRICS = {"title": ["TitleV"], "body": ["BodyV"], "title-body": ["TitleV", "BodyV"]}


def vectors(t: Tables) -> DataFrame:
    return t.v("TitleV", "BodyV").withColumnRenamed("PostId", "doc")


def three_metrics(t: Tables, n: int | None, floor: float | None = None, apart: bool = False) -> DataFrame:
    """(metric, qid, doc, sim): titles asked against titles, bodies and the mean of both, in one pass over the vectors."""
    return S.dense_best(asked(t, "TitleV"), vectors(t), {m: [(f, None) for f in fs] for m, fs in _METRICS.items()}, n, floor, apart)


def ranked(scores: DataFrame, n: int) -> DataFrame:
    return S.best(scores, n, ("metric", "qid")).select("metric", "qid", "doc", "rank")


_TOPS = f"WITH {_SPACES} SELECT metric, qid, doc, row_number() OVER (PARTITION BY metric, qid ORDER BY sim DESC, doc) AS rank FROM every QUALIFY rank <= 20"


@P.add("topk_per_query", f"WITH {_SPACES} SELECT qid, doc, sim, {_RANK} FROM tb QUALIFY rank <= 5", "v")
def topk_per_query(t: Tables) -> DataFrame:
    """The five best bodies for every title asked, with their similarities and ranks."""
    bodies = t.v("BodyV").select(F.col("PostId").alias("doc"), F.col("BodyV").alias("vec"))
    return S.best(S.dense_scores(asked(t, "TitleV"), bodies, 5), 5)


@P.add("batch_sims", _TOPS, "v")
def batch_sims(t: Tables) -> DataFrame:
    return ranked(three_metrics(t, 20), 20)


@P.add("cross_join_similarity", f"WITH {_SPACES}, r AS (SELECT *, {_RANK} FROM tt QUALIFY rank <= 10) SELECT qid, doc, sim FROM r", "v")
def cross_join_similarity(t: Tables) -> DataFrame:
    return S.dense_scores(asked(t, "TitleV"), dense(t, "TitleV"), 10)


@P.add("threshold_sorted", f"WITH {_SPACES} SELECT metric, qid, string_agg(doc, ' ' ORDER BY sim DESC, doc) AS docs FROM every WHERE sim > 0.3 GROUP BY metric, qid", "v")
def threshold_sorted(t: Tables) -> DataFrame:
    """All hits above the threshold per query, best first: the list is the result's row."""
    hits = three_metrics(t, None, 0.3)
    listed = hits.groupBy("metric", "qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("k"), "doc"))).alias("x"))
    return listed.select("metric", "qid", F.concat_ws(" ", F.transform("x", lambda z: z["doc"].cast("string"))).alias("docs"))


_PAIR = "WITH p AS (SELECT DISTINCT PostId AS s, RelatedPostId AS d FROM l), tv AS (SELECT PostId AS doc, TitleV::DOUBLE[] AS vec FROM v WHERE len(TitleV) = 128), bv AS (SELECT PostId AS doc, BodyV::DOUBLE[] AS vec FROM v WHERE len(BodyV) = 128), " + (
    f"g AS (SELECT s, d, round({_COS}, 6) AS title FROM p JOIN tv x ON x.doc = s JOIN tv y ON y.doc = d), h AS (SELECT s, d, round({_COS}, 6) AS body FROM p JOIN bv x ON x.doc = s JOIN bv y ON y.doc = d), z AS (SELECT s, d, title, body FROM g JOIN h USING (s, d))"
)


def pair_similarity(t: Tables) -> DataFrame:
    """(s, d, title, body): the cosines of linked posts, by two joins of the edge list with the vectors."""
    v = t.v("TitleV", "BodyV").where("size(TitleV) = 128 and size(BodyV) = 128")
    pairs = t.l("PostId", "RelatedPostId").select(F.col("PostId").alias("s"), F.col("RelatedPostId").alias("d")).distinct()
    both = pairs.join(v.select(F.col("PostId").alias("s"), F.col("TitleV").alias("t1"), F.col("BodyV").alias("b1")), "s")
    both = both.join(v.select(F.col("PostId").alias("d"), F.col("TitleV").alias("t2"), F.col("BodyV").alias("b2")), "d")
    return both.select("s", "d", F.round(S.cosine(F.col("t1"), F.col("t2")), 6).alias("title"), F.round(S.cosine(F.col("b1"), F.col("b2")), 6).alias("body"))


@P.add("pair_join_similarity", _PAIR + " SELECT s, d, title, body FROM z", "l v")
def pair_join_similarity(t: Tables) -> DataFrame:
    return pair_similarity(t)


@P.add("cosine_similarity", f"WITH x AS (SELECT PostId AS doc, TitleV::DOUBLE[] AS vec FROM v WHERE len(TitleV) = 128), y AS (SELECT PostId AS doc, BodyV::DOUBLE[] AS vec FROM v WHERE len(BodyV) = 128) SELECT x.doc, round({_COS}, 6) AS sim FROM x JOIN y ON x.doc = y.doc", "v")
def cosine_similarity(t: Tables) -> DataFrame:
    """How like a post's title and body are, in the row itself."""
    rows = t.v("TitleV", "BodyV").where("size(TitleV) = 128 and size(BodyV) = 128")
    return rows.select(F.col("PostId").alias("doc"), F.round(S.cosine(F.col("TitleV"), F.col("BodyV")), 6).alias("sim"))


@P.add("threshold_counts", _PAIR + " SELECT round(100.0 * count(*) FILTER (title >= 0.3) / count(*), 2) AS title, round(100.0 * count(*) FILTER (body >= 0.3) / count(*), 2) AS body, round(100.0 * count(*) FILTER ((title + body) / 2 >= 0.3) / count(*), 2) AS both FROM z", "l v")
def threshold_counts(t: Tables) -> DataFrame:
    def share(x):
        return F.round(F.try_divide(100.0 * F.sum(F.when(x >= 0.3, 1).otherwise(0)), F.count("*")), 2)

    return pair_similarity(t).agg(share(F.col("title")).alias("title"), share(F.col("body")).alias("body"), share((F.col("title") + F.col("body")) / 2).alias("both"))


_SPARSE_ASK = f"""WITH {_space('Title', 't')},
    bk AS (SELECT Id AS doc, unnest(regexp_extract_all(lower(Body), '[^ \\t\\n\\r\\f\\x0B]{{2,}}')) AS term FROM q WHERE Body IS NOT NULL),
    bx AS (SELECT doc, term, count(*) * any_value(idf) AS x FROM bk JOIN ti USING (term) GROUP BY ALL),
    bw AS (SELECT doc, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS w FROM bx),
    sp AS (SELECT x.doc AS qid, y.doc, sum(x.w * y.w) AS sim FROM tw x JOIN tw y USING (term) WHERE x.doc % 50 = 0 GROUP BY ALL),
    sb AS (SELECT x.doc AS qid, y.doc, sum(x.w * y.w) AS sim FROM tw x JOIN bw y USING (term) WHERE x.doc % 50 = 0 GROUP BY ALL), {_SPACES}"""


def sparse_asked(t: Tables) -> DataFrame:
    """(qid, doc, sim): titles asked against titles, in their space."""
    titles = model(t, "Title")[0].own_vectors()
    return S.sparse_scores(titles.where("doc % 50 = 0").select(F.col("doc").alias("qid"), "term", F.col("w").alias("qw")), titles)


_HYBRID = (
    _SPARSE_ASK
    + """, ht AS (SELECT qid, doc, coalesce(sp.sim, 0) + tt.sim AS sim FROM tt LEFT JOIN sp USING (qid, doc)), hb AS (SELECT qid, doc, coalesce(sb.sim, 0) + tb.sim AS sim FROM tb LEFT JOIN sb USING (qid, doc)),
    r AS (SELECT 'title' AS metric, qid, doc, round(sim, 6) AS sim FROM ht UNION ALL SELECT 'body', qid, doc, round(sim, 6) FROM hb UNION ALL SELECT 'title-body', qid, doc, round((ht.sim + hb.sim) / 2, 6) FROM ht JOIN hb USING (qid, doc))"""
)
_RANKED = "row_number() OVER (PARTITION BY metric, qid ORDER BY sim DESC, doc) AS rank"


def sparse_lists(m: S.TfIdf, counts: DataFrame, numbered: DataFrame, name: str) -> DataFrame:
    """(doc, name_t, name_w) of (doc, term, tf): unit vectors in the space of `m` as two lists of a document, of which only
    the terms that have a number are kept."""
    raw = counts.join(numbered, "term").select("doc", "t", (F.col("tf") * F.col("idf")).alias("x"))
    each = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"), F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "x"))).alias("v"))
    return each.select("doc", F.transform("v", lambda z: z["t"]).alias(f"{name}_t"), F.transform("v", lambda z: z["x"] / F.col("n")).alias(f"{name}_w"))


def hybrid(t: Tables, n: int, fields: dict[str, list[str]], most_sent: int = 1_000_000) -> DataFrame:
    """(metric, qid, doc, sim): sparse plus dense similarity, no factor 1/2; documents need the dense vectors. A document
    brings its sparse vectors, in the space of the titles, into the pass over its dense ones: no pair of a query and a
    document is ever a row but for the best. Terms are numbered where a query has them; ids of the documents with vectors
    (8 bytes) are broadcast while they are at most `most_sent`, else joined."""
    m = model(t, "Title")[0]
    docs, asks = vectors(t), asked(t, "TitleV")
    held = cut(docs.select("doc"))
    held = F.broadcast(held) if held.count() <= most_sent else held
    mine = m.trained.join(asks.select(F.col("qid").alias("doc")), "doc", "left_semi").select("term").distinct()
    numbered = cut(m.vocabulary.select("term", "idf").join(mine.select("term", F.monotonically_increasing_id().alias("t")), "term", "left"))
    titles = kept(sparse_lists(m, m.trained.join(held, "doc", "left_semi"), numbered, "TitleV"), "titles")
    sparse = [titles]
    if any("BodyV" in fs for fs in fields.values()):
        texts = t.q("Body").where("Body is not null").join(held.withColumnRenamed("doc", "Id"), "Id", "left_semi")
        sparse.append(kept(sparse_lists(m, m.counts(texts, "Id", "Body"), numbered, "BodyV"), "bodies"))
    asks = asks.join(titles.select(F.col("doc").alias("qid"), F.col("TitleV_t").alias("terms"), F.col("TitleV_w").alias("weights")), "qid", "left")
    for lists in sparse:
        docs = docs.join(lists, "doc", "left")
    return S.dense_best(asks, docs, {x: [(f, f) for f in fs] for x, fs in fields.items()}, n, most_queries=65_536)


@P.add("rank_hybrid", _HYBRID + f" SELECT qid, doc, {_RANK} FROM r WHERE metric = 'title' QUALIFY rank <= 20", "q v")
def rank_hybrid(t: Tables) -> DataFrame:
    return ranked(hybrid(t, 20, {"title": ["TitleV"]}), 20).select("qid", "doc", "rank")


@P.add("batch_hybrid_sims", _HYBRID + f" SELECT metric, qid, doc, {_RANKED} FROM r QUALIFY rank <= 20", "q v")
def batch_hybrid_sims(t: Tables) -> DataFrame:
    return ranked(hybrid(t, 20, _METRICS), 20)


@P.add("rank_rerank", _SPARSE_ASK + f", f AS (SELECT qid, doc FROM (SELECT qid, doc, round(sim, 6) AS sim FROM sp) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, doc) <= 200), r AS (SELECT * FROM every JOIN f USING (qid, doc)) SELECT metric, qid, doc, {_RANKED} FROM r QUALIFY rank <= 20", "q v")
def rank_rerank(t: Tables) -> DataFrame:
    """The sparse best 200 by dense similarity, in three metrics."""
    first = S.best(sparse_asked(t).withColumn("sim", F.round("sim", 6)), 200).select("qid", "doc")
    pairs = first.join(asked(t, "TitleV").withColumnRenamed("vec", "qv"), "qid").join(vectors(t), "doc")
    sims = {f: F.when(F.size(f) == 128, F.round(S.cosine(F.col("qv"), F.col(f)), 6)) for f in ("TitleV", "BodyV")}
    named = [F.struct(F.lit(m).alias("metric"), (sum(sims[f] for f in fs) / len(fs)).alias("sim")) for m, fs in _METRICS.items()]
    again = pairs.select("qid", "doc", F.explode(F.array(*named)).alias("x")).select("x.metric", "qid", "doc", F.round("x.sim", 6).alias("sim"))
    return ranked(again.where("sim is not null"), 20)


# evaluation

_SEARCHES = f"WITH {_SPACES}, s AS (SELECT metric, qid AS src, doc AS dst FROM every WHERE doc <> qid QUALIFY row_number() OVER (PARTITION BY metric, qid ORDER BY sim DESC, doc) <= 20), lk AS (SELECT PostId AS src, RelatedPostId AS dst FROM l WHERE PostId IS NOT NULL AND RelatedPostId IS NOT NULL UNION SELECT RelatedPostId, PostId FROM l WHERE PostId IS NOT NULL AND RelatedPostId IS NOT NULL)"


def searches(t: Tables) -> DataFrame:
    return three_metrics(t, 20, apart=True).select("metric", F.col("qid").alias("src"), F.col("doc").alias("dst"))


@P.add("postlink_searches", _SEARCHES + " SELECT metric, src, dst FROM s", "l v")
def postlink_searches(t: Tables) -> DataFrame:
    return searches(t)


@P.add("hit_percentage", _SEARCHES + " SELECT round(100.0 * (SELECT count(*) FROM s JOIN lk USING (src, dst) WHERE metric = 'title') / ((SELECT count(*) FROM lk) / 2), 2) AS percent", "l v")
def hit_percentage(t: Tables) -> DataFrame:
    found = searches(t).where("metric = 'title'").select("src", "dst")
    return E.hit_percentage(found, R.symmetric(t.l("PostId", "RelatedPostId"), "PostId", "RelatedPostId"))


_LOOKED = "i AS (SELECT PostId AS s, RelatedPostId AS d FROM l WHERE PostId IN (SELECT Id FROM q) AND RelatedPostId IN (SELECT Id FROM q)), b AS (SELECT n FROM (SELECT s AS n FROM i UNION ALL SELECT d FROM i) GROUP BY n HAVING count(*) >= 2), k AS (SELECT s, d FROM i WHERE s IN (SELECT n FROM b) AND d IN (SELECT n FROM b)), look AS (SELECT s AS src, d AS dst FROM k UNION SELECT d, s FROM k)"


@P.add("postlink_eval", _SEARCHES + f", {_LOOKED} SELECT metric, count(look.src) AS hits, count(*) AS results FROM s LEFT JOIN look USING (src, dst) GROUP BY metric", "l v q")
def postlink_eval(t: Tables) -> DataFrame:
    marked = searches(t).join(lookup(t).withColumn("hit", F.lit(1)), ["src", "dst"], "left")
    return marked.groupBy("metric").agg(F.count("hit").alias("hits"), F.count("*").alias("results"))


_REL = "rel AS (SELECT ParentId AS query_id, row_number() OVER (PARTITION BY ParentId ORDER BY Id) AS rank, CASE WHEN Score >= 2 THEN 1 ELSE 0 END AS rel FROM a WHERE ParentId IS NOT NULL QUALIFY rank <= 20)"


def relevance(t: Tables) -> DataFrame:
    """A question's first 20 answers as ranked results; good scores are relevant."""
    w = Window.partitionBy("ParentId").orderBy("Id")
    rows = t.a("ParentId", "Score").where("ParentId is not null").withColumn("rank", F.row_number().over(w)).where("rank <= 20")
    return rows.select(F.col("ParentId").alias("query_id"), "rank", F.when(F.col("Score") >= 2, 1).otherwise(0).alias("rel"))


_RUN = f"WITH {_REL}, p AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) / rank AS prec FROM rel)"


@P.add("running_precision", _RUN + " SELECT query_id, rank, round(prec, 6) AS precision FROM p", "a")
def running_precision(t: Tables) -> DataFrame:
    return E.running_precision(relevance(t)).select("query_id", "rank", F.round("precision", 6).alias("precision"))


_KS = (5, 10, 15, 20)
_AP = " UNION ALL ".join(f"SELECT query_id, {k} AS k, round(sum(prec * rel) / {k}, 6) AS ap FROM p WHERE rank <= {k} GROUP BY query_id" for k in _KS)


def _aps(t: Tables) -> DataFrame:
    rel = relevance(t)
    parts = [E.average_precision(rel, k).select("query_id", F.lit(k).alias("k"), F.round("ap", 6).alias("ap")) for k in _KS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@P.add("average_precision", f"{_RUN} {_AP}", "a")
def average_precision(t: Tables) -> DataFrame:
    return _aps(t)


@P.add("mean_average_precision", f"{_RUN}, x AS ({_AP}) SELECT k, round(avg(ap), 4) AS map FROM x GROUP BY k", "a")
def mean_average_precision(t: Tables) -> DataFrame:
    return _aps(t).groupBy("k").agg(F.round(F.avg("ap"), 4).alias("map"))


_LEN = " UNION ALL ".join(f"SELECT {n} AS n, query_id, coalesce(min(rank) FILTER (hits = {n}) - {n}, 20) AS len FROM h GROUP BY query_id" for n in (1, 3))


@P.add("mean_search_length", f"WITH {_REL}, h AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM rel), x AS ({_LEN}) SELECT n, round(avg(len), 4) AS msl FROM x GROUP BY n", "a")
def mean_search_length(t: Tables) -> DataFrame:
    rel = relevance(t)
    parts = [E.search_length(rel, n, 20).agg(F.round(F.avg("length"), 4).alias("msl")).select(F.lit(n).alias("n"), "msl") for n in (1, 3)]
    return parts[0].unionByName(parts[1])


@P.add("group_labels", "SELECT Id, ntile(18) OVER (ORDER BY Id) - 1 AS grp FROM q", "q")
def group_labels(t: Tables) -> DataFrame:
    return E.equal_groups(t.q(), "Id", 18).select("Id", "grp")


@P.add("binary_metrics", "WITH s AS (SELECT sum(CASE WHEN x AND y THEN 1 ELSE 0 END) AS tp, sum(y::INT) AS g, sum(x::INT) AS a FROM (SELECT Score >= 2 AS x, AnswerCount >= 2 AS y FROM q WHERE Score IS NOT NULL)), r AS (SELECT tp / (g + 1e-7) AS p, tp / (a + 1e-7) AS r FROM s) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-7), 6) AS f1 FROM r", "q")
def binary_metrics(t: Tables) -> DataFrame:
    rows = t.q("Score", "AnswerCount").where("Score is not null").select((F.col("Score") >= 2).alias("x"), (F.col("AnswerCount") >= 2).alias("y"))
    return E.binary_metrics(rows, "x", "y")


# metadata, index, search


def metadata(t: Tables) -> DataFrame:
    """PostId, Score, Title, etags, SnippetCount, Snippets of questions with snippets."""
    tags = F.regexp_extract_all(F.lower(F.coalesce("Tags", F.lit(""))), F.lit("([a-z0-9][a-z0-9.#+-]*)"), F.lit(1))
    ents = F.transform(F.split(F.coalesce("Entities", F.lit("")), "<_ent_>"), lambda x: F.lower(x))
    etags = F.array_sort(F.filter(F.array_union(tags, ents), lambda x: x != ""))
    rows = t.q("Title", "Tags", "Entities", "Score").join(snippets_of(t), F.col("Id") == F.col("ParentId"))
    return rows.select(F.col("Id").alias("PostId"), "Score", "Title", etags.alias("etags"), "SnippetCount", "Snippets")


_META = f"cd AS (SELECT ParentId, Id, Score, {code_parts_sql('Body')} AS s FROM a WHERE ParentId IS NOT NULL AND Body IS NOT NULL)," + r"""
    sn AS (SELECT ParentId, sum(len(s))::BIGINT AS SnippetCount, string_agg('Post: https://qa.example/questions/' || Id || chr(10) || '##Score ' || coalesce(Score, 0) || chr(10) || array_to_string(s, '<_code_>'), '<_post_>' ORDER BY Score DESC NULLS LAST, Id) AS Snippets FROM cd WHERE len(s) > 0 GROUP BY ParentId),
    meta AS (SELECT q.Id AS PostId, Score, Title, list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(lower(coalesce(Tags, '')), '[a-z0-9][a-z0-9.#+-]*'), list_transform(string_split(coalesce(Entities, ''), '<_ent_>'), lambda x: lower(x))), lambda x: x <> ''))) AS etags, sn.SnippetCount, sn.Snippets FROM q JOIN sn ON q.Id = sn.ParentId)"""


@P.add("build_metadata_index", f"WITH {_META} SELECT PostId, Score, Title, array_to_string(etags, '|') AS etags, SnippetCount, Snippets FROM meta", "q a")
def build_metadata_index(t: Tables) -> DataFrame:
    return metadata(t).withColumn("etags", F.array_join("etags", "|"))


_FOUND = f"WITH {_space('Title', 't')}, {_queries('t')}, {_META}, r AS (SELECT doc, round(sim, 6) AS sim FROM ts JOIN meta ON doc = PostId WHERE qid = 3 AND list_has_any(etags, ['swing', 'java']) ORDER BY round(sim, 6) DESC, doc LIMIT 20)"


SEARCHED = _QUERIES[2][1]
FOUND_IN_TITLES = _FOUND + " SELECT row_number() OVER (ORDER BY sim DESC, doc) AS rank, PostId, round(sim, 4) AS sim, 'https://qa.example/questions/' || PostId AS link FROM r JOIN meta ON doc = PostId"


@P.add("search", FOUND_IN_TITLES, "q a")
def search(t: Tables) -> DataFrame:
    return indexed(t, ("Title",)).search(SEARCHED, "swing, java", 20).select("rank", "PostId", "sim", "link")


@P.add("metadata_frame", _FOUND + r" SELECT PostId, Title, SnippetCount, regexp_extract(string_split(Snippets, '<_post_>')[1], 'Post: ([^\n]*)', 1) AS anslink, round(sim, 4) AS sim FROM r JOIN meta ON doc = PostId", "q a")
def metadata_frame(t: Tables) -> DataFrame:
    return indexed(t, ("Title",)).search(SEARCHED, ["swing", "java"], 20).select("PostId", "Title", "SnippetCount", "anslink", "sim")


QUERIES, SQL = P.QUERIES, P.SQL
