"""The registered queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v != v:
            return "-"
        return repr(round(float(v), 5) + 0.0) if isinstance(v, float) else str(v).removesuffix(".0")

    return sorted(tuple(repr(float(c)) if isinstance(c, int) else cell(c) for c in r) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k in {
    "rank_topk", "tfidf_vectors", "batch_sims", "rank_hybrid", "search", "postlink_lookup", "join_question_answers", "agg_snippets", "normalize_text",
    "eval_text", "word_index", "pad_sequence", "feat_type", "entity_merge", "glove_cooccurrence", "mean_search_length", "threshold_sorted", "scan_xml_dump"
}))
def test_query_equals_sql(spark, con, name):
    got = rows(entry.queries()[name](spark, DATA).toPandas())
    want = rows(con.execute(entry.oracle_sql()[name]).fetchdf())
    norm = lambda rs: sorted(tuple(c.removesuffix(".0") for c in r) for r in rs)
    assert norm(got) == norm(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_index_covers_bodies(spark, con):
    from askloom.plans.base import Tables
    from askloom.plans.search import model

    got = {r["PostId"]: r["terms"] for r in entry.queries()["sink_index"](spark, DATA).collect()}
    want = {}
    for key in ("Title", "Body"):
        m, docs = model(Tables(spark, DATA), key)
        for r in m.vectors(docs, "Id", key).groupBy("doc").count().collect():
            want[r["doc"]] = want.get(r["doc"], 0) + r["count"]
    assert got and got == {i: want.get(i, 0) for i in got}


@pytest.mark.parametrize("name", ["fasttext_train", "glove_train"])
def test_word_vectors_know_words_of_bodies(spark, con, name):
    titles = {w for (t,) in con.execute("SELECT lower(Title) FROM questions WHERE Title IS NOT NULL").fetchall() for w in t.split()}
    got = {r["token"] for r in entry.queries()[name](spark, DATA).select("token").collect()}
    assert len(got - titles) > 100
