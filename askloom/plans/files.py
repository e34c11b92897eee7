"""Queries that write a format and read it back: the result must equal the rows of the source table."""

from __future__ import annotations

import sqlite3
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.functions.text import remove_paths
from askloom.operators.retrieval import SearchEngine
from askloom.plans.base import Part, Tables
from askloom.plans.search import _META, FOUND_IN_TITLES, SEARCHED, _space, indexed, metadata
from askloom.plans.tokens import _WORDS, words
from askloom.session import shared_folder
from askloom.sources import readers as R
from askloom.sources import writers as W

P = Part()


def folder(t: Tables, name: str) -> str:
    """A fresh place in the shared folder."""
    return f"{shared_folder(t.spark).rstrip('/')}/files-{uuid.uuid4().hex}/{name}"


_TITLES = r"SELECT Id, trim(regexp_replace(Title, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS Title FROM q WHERE Title IS NOT NULL"


def titles(t: Tables) -> DataFrame:
    return t.q("Title").where("Title is not null").select("Id", F.trim(F.regexp_replace("Title", r"[ \t\n\r\f\x0B]+", " ")).alias("Title"))


@P.add("sink_table", _TITLES, "q")
def sink_table(t: Tables) -> DataFrame:
    path = folder(t, "titles")
    W.write_table(titles(t), path)
    return t.spark.read.parquet(path)


@P.add("sink_frame", "SELECT Id, Score, FavoriteCount, CreationDate AT TIME ZONE 'UTC' AS CreationDate, string_split(Title, ' ') AS ws FROM q", "q")
def sink_frame(t: Tables) -> DataFrame:
    """A frame of numbers, nulls, times and lists, stored and read back with its types."""
    path = folder(t, "frame")
    W.write_table(t.q("Score", "FavoriteCount", "CreationDate", "Title").withColumn("ws", F.split("Title", " ")).drop("Title"), path)
    return t.spark.read.parquet(path)


@P.add("sink_insert_or_replace", f"{_TITLES} UNION ALL {_TITLES}", "q")
def sink_insert_or_replace(t: Tables) -> DataFrame:
    path = folder(t, "titles")
    W.write_table(titles(t), path)
    W.append_table(titles(t), path)
    return t.spark.read.parquet(path)


@P.add("union_partitions", _TITLES, "q")
def union_partitions(t: Tables) -> DataFrame:
    """Partition files come together by reading their folder."""
    path = folder(t, "parts")
    W.write_table(titles(t).withColumn("part", F.pmod(F.xxhash64("Id"), F.lit(3))), path, by="part")
    return t.spark.read.parquet(path).select("Id", "Title")


@P.add("scan_npy", "SELECT PostId AS doc, len(TitleV) AS n, round(list_sum(TitleV::DOUBLE[]), 6) AS total FROM v WHERE len(TitleV) > 0", "v")
def scan_npy(t: Tables) -> DataFrame:
    """Matrices stored in partition files, read by the prefix of their names; those of another prefix stay unread."""
    path, v = folder(t, "matrices"), t.v("TitleV", "BodyV")
    for k in range(3):
        W.write_table(v.where(F.pmod(F.xxhash64("PostId"), F.lit(3)) == k).select("PostId", F.col("TitleV").alias("vec")), f"{path}/title-{k}")
    W.write_table(v.select("PostId", F.col("BodyV").alias("vec")), f"{path}/body-0")
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return t.spark.read.parquet(f"{path}/title-*").where("size(vec) > 0").select(F.col("PostId").alias("doc"), F.size("vec").cast("long").alias("n"), F.round(total, 6).alias("total"))


@P.add("scan_pickle", f"WITH {_META} SELECT PostId, len(etags) AS tags, etags[1] AS first, SnippetCount FROM meta", "q a")
def scan_pickle(t: Tables) -> DataFrame:
    """A stored metadata frame with lists in its cells."""
    path = folder(t, "metadata")
    W.write_table(metadata(t), path)
    return t.spark.read.parquet(path).select("PostId", F.size("etags").cast("long").alias("tags"), F.get("etags", F.lit(0)).alias("first"), "SnippetCount")


@P.add("sink_text", f"SELECT Title AS line FROM ({_TITLES})", "q")
def sink_text(t: Tables) -> DataFrame:
    path = folder(t, "lines")
    W.write_text(titles(t), "Title", path)
    return R.text_lines(t.spark, path)


@P.add("scan_text", f"SELECT row_number() OVER (ORDER BY Id) - 1 AS pos, Title AS line FROM ({_TITLES})", "q")
def scan_text(t: Tables) -> DataFrame:
    """Lines with their numbers over all files of a folder, counted without a single task."""
    path = folder(t, "lines")
    W.write_text(titles(t).repartitionByRange(4, "Id").sortWithinPartitions("Id"), "Title", path)
    return R.numbered_lines(t.spark, path).select(F.col("pos").cast("long").alias("pos"), "line")


@P.add("line_feed", rf"SELECT regexp_replace(Title || ' C:\ab\cd\ef', '\b((?:[Cc]:)?(?:\\\S{{2,}}){{2,}})\b', ' ', 'g') AS line FROM ({_TITLES})", "q")
def line_feed(t: Tables) -> DataFrame:
    """Lines of a file, each through a function: paths are taken out."""
    path = folder(t, "lines")
    W.write_text(titles(t).select(F.concat("Title", F.lit(" C:\\ab\\cd\\ef")).alias("Title")), "Title", path)
    return R.text_lines(t.spark, path).select(remove_paths(F.col("line")).alias("line"))


@P.add("scan_json", "SELECT Id, array_to_string(string_split(Title, ' '), '|') AS words, len(Title) AS n FROM q WHERE Title IS NOT NULL", "q")
def scan_json(t: Tables) -> DataFrame:
    """Rows whose cells hold lists and records, read with their schema."""
    path = folder(t, "json")
    rows = t.q("Title").where("Title is not null").select("Id", F.split("Title", " ").alias("ws"), F.struct(F.length("Title").alias("n")).alias("about"))
    W.write_json(rows, path)
    return R.json_rows(t.spark, path, "Id long, ws array<string>, about struct<n: long>").select("Id", F.array_join("ws", "|").alias("words"), "about.n")


@P.add("sink_json", _TITLES, "q")
def sink_json(t: Tables) -> DataFrame:
    path = folder(t, "json")
    W.write_json(titles(t), path)
    return R.json_rows(t.spark, path, "Id long, Title string")


@P.add("scan_labels", "SELECT row_number() OVER (ORDER BY Id) - 1 AS pos, NOT (Score % 2 <> 0) AS label FROM q WHERE Score IS NOT NULL", "q")
def scan_labels(t: Tables) -> DataFrame:
    path = folder(t, "labels")
    rows = t.q("Score").where("Score is not null").repartitionByRange(4, "Id").sortWithinPartitions("Id")
    rows.select((F.abs("Score") % 2).cast("string").alias("value")).write.text(path)
    return R.labels(t.spark, path, "bool")


_XML = {"Id": "long", "Score": "int", "Title": "string", "CreationDate": "timestamp"}


@P.add("scan_xml_dump", "SELECT Id, Score, trim(regexp_replace(Title, '[^A-Za-z0-9 ]', '', 'g')) AS Title, date_trunc('second', CreationDate AT TIME ZONE 'UTC') AS CreationDate FROM q", "q")
def scan_xml_dump(t: Tables) -> DataFrame:
    """Questions as a dump of <row/> elements, with a malformed and an unknown attribute among them."""
    path = folder(t, "dump.xml")
    text = F.trim(F.regexp_replace("Title", "[^A-Za-z0-9 ]", ""))
    at = F.date_format("CreationDate", "yyyy-MM-dd'T'HH:mm:ss")
    attrs = [F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), v.cast("string"), F.lit('"'))).otherwise("") for k, v in (("Id", F.col("Id")), ("Score", F.col("Score")), ("Title", text), ("CreationDate", at))]
    line = F.concat(F.lit("  <row"), *attrs, F.lit(" />"))
    bad = t.spark.createDataFrame([('  <row Id="x1" Score="2" />',), ("  <row />",)], "value string")
    rows = t.q("Score", "Title", "CreationDate").select(line.alias("value")).unionByName(bad).withColumn("at", F.lit(1))
    ends = t.spark.createDataFrame([("<posts>", 0), ("</posts>", 2)], "value string, at int")
    # a dump is one document, hence one file
    rows.unionByName(ends).repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    return R.xml_dump(t.spark, path, _XML)


@P.add("scan_sql", "SELECT Id, Score FROM q WHERE Score >= 2", "q")
def scan_sql(t: Tables) -> DataFrame:
    """Rows of a query and of a table in an SQLite file. The file format has one writer, so the driver writes it."""
    path = folder(t, "posts.db").removeprefix("file:")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE posts (Id INTEGER, Score INTEGER)")
        rows = t.q("Score").select("Id", "Score").toLocalIterator(prefetchPartitions=True)
        con.executemany("INSERT INTO posts VALUES (?, ?)", ((r[0], r[1]) for r in rows))
    return R.sqlite(t.spark, path, table="posts", slices=3).where("Score >= 2")


@P.add("scan_wordvec", "SELECT DISTINCT 't' || (length(Title) % 50) AS token, length(Title) % 50 + 0.5 AS v1, 2.0 AS v2 FROM q WHERE Title IS NOT NULL", "q")
def scan_wordvec(t: Tables) -> DataFrame:
    path = folder(t, "words.vec")
    rows = t.q("Title").where("Title is not null").select((F.length("Title") % 50).alias("n")).distinct()
    lines = rows.select(F.concat(F.lit("t"), F.col("n").cast("string"), F.lit(" "), (F.col("n") + 0.5).cast("string"), F.lit(" 2.0")).alias("value"))
    lines.unionByName(t.spark.createDataFrame([("50 2",)], "value string")).write.text(path)
    return R.word_vectors(t.spark, path).select("token", F.get("vec", 0).cast("double").alias("v1"), F.get("vec", 1).cast("double").alias("v2"))


_CONLL = f"WITH w AS ({_WORDS}), k AS (SELECT Id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM w)"


def _conll_file(t: Tables, line) -> str:
    path = folder(t, "tokens.conll")
    text = F.concat(F.array_join(F.transform("ws", line), "\n"), F.lit("\n"))
    words(t).select(text.alias("value")).write.text(path)
    return path


@P.add("scan_conll", _CONLL + " SELECT token, 'O' AS entity, count(*) AS n FROM k GROUP BY token", "q")
def scan_conll(t: Tables) -> DataFrame:
    got = R.conll(t.spark, _conll_file(t, lambda w: F.concat(w, F.lit(" O"))))
    return got.select(F.explode("items").alias("x")).groupBy("x.token", "x.entity").agg(F.count("*").alias("n"))


@P.add("conll_convert", _CONLL + " SELECT token, 'B-X' AS label, count(*) AS n FROM k GROUP BY token", "q")
def conll_convert(t: Tables) -> DataFrame:
    path = _conll_file(t, lambda w: F.concat(F.lit("B-X 0 1 "), w))
    return R.conll_columns(t.spark, path).where("token is not null").groupBy("token", "label").agg(F.count("*").alias("n"))


@P.add("scan_brown", _CONLL + " SELECT token, CASE WHEN length(token) % 2 = 0 THEN '0110' ELSE '10' END AS path, count(*) AS n FROM k WHERE NOT contains(token, '\"') GROUP BY token", "q")
def scan_brown(t: Tables) -> DataFrame:
    path = folder(t, "paths")
    n = words(t).select(F.explode("ws").alias("token")).where(~F.col("token").contains('"')).groupBy("token").agg(F.count("*").alias("n"))
    bits = F.when(F.length("token") % 2 == 0, "0110").otherwise("10")
    n.select(F.concat_ws("\t", bits, "token", F.col("n").cast("string")).alias("value")).write.text(path)
    return R.brown_paths(t.spark, path)


@P.add("scan_gazetteer", _CONLL + " SELECT DISTINCT lower(token) AS name FROM k", "q")
def scan_gazetteer(t: Tables) -> DataFrame:
    path = folder(t, "names")
    words(t).select(F.explode("ws").alias("value")).write.text(path)
    return R.gazetteer(t.spark, path)


@P.add("sink_api_index", _CONLL + " SELECT token, count(*) AS n FROM k GROUP BY token", "q")
def sink_api_index(t: Tables) -> DataFrame:
    path = folder(t, "api")
    W.write_api_index(words(t), "ws", path)
    return t.spark.read.text(path).groupBy(F.col("value").alias("token")).agg(F.count("*").alias("n"))


@P.add("sink_crf_features", _CONLL + " SELECT 'O' || chr(9) || 'w=' || token AS line, count(*) AS n FROM k GROUP BY token", "q")
def sink_crf_features(t: Tables) -> DataFrame:
    path = folder(t, "features")
    items = F.transform("ws", lambda w: F.struct(F.lit("O").alias("label"), F.array(F.concat(F.lit("w="), w)).alias("F")))
    W.write_features(words(t).select(items.alias("items")), "items", path)
    return t.spark.read.text(path).where("value <> ''").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@P.add("sink_predictions", "SELECT Id, CASE WHEN Score >= 2 THEN 1 ELSE 0 END AS prediction FROM q WHERE Score IS NOT NULL", "q")
def sink_predictions(t: Tables) -> DataFrame:
    path = folder(t, "predictions")
    W.write_predictions(t.q("Score").where("Score is not null").withColumn("p", F.when(F.col("Score") >= 2, 0.75).otherwise(0.25)), "Id", "p", path)
    return t.spark.read.parquet(path)




_SIZES = f"WITH {_space('Title', 't')}, {_space('Body', 'b')}, {_META}, "


@P.add("sink_index", _SIZES + "x AS (SELECT doc, count(*) AS terms FROM (SELECT doc FROM tw UNION ALL SELECT doc FROM bw) GROUP BY doc) SELECT PostId, SnippetCount, coalesce(terms, 0) AS terms FROM meta LEFT JOIN x ON PostId = doc", "q a")
def sink_index(t: Tables) -> DataFrame:
    """Vectors of Title and Body and the metadata written and read back: every post with the size of its two vectors."""
    path = folder(t, "index")
    spaces = [v.withColumn("key", F.lit(f)) for _, fields in indexed(t).spaces.values() for f, v in fields.items()]
    W.write_index(spaces[0].unionByName(spaces[1]), metadata(t), path)
    sizes = t.spark.read.parquet(f"{path}/vectors").groupBy("doc").agg(F.count("*").alias("terms"))
    posts = t.spark.read.parquet(f"{path}/metadata").select("PostId", "SnippetCount")
    return posts.join(sizes, F.col("PostId") == F.col("doc"), "left").select("PostId", "SnippetCount", F.coalesce("terms", F.lit(0)).alias("terms"))


_PARTS = " UNION ALL ".join(
    f"SELECT '{name}' AS part, count(*) AS n, count(DISTINCT {key}) AS keys FROM {source}"
    for name, source, key in (("title words", "ti", "term"), ("title vectors", "tw", "doc"), ("body words", "bi", "term"), ("body vectors", "bw", "doc"), ("metadata", "meta", "PostId"))
)


@P.add("build_index", f"{_SIZES[:-2]} {_PARTS}", "q a")
def build_index(t: Tables) -> DataFrame:
    """The whole index saved: models, vectors by field and metadata, with the rows and keys each part holds on disk."""
    path = folder(t, "index")
    indexed(t).save(path)
    parts = (("title words", "title/model", "term"), ("title vectors", "title/Title", "doc"), ("body words", "body/model", "term"), ("body vectors", "body/Body", "doc"), ("metadata", "metadata", "PostId"))
    rows = [t.spark.read.parquet(f"{path}/{at}").agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys")).select(F.lit(name).alias("part"), "n", "keys") for name, at, key in parts]
    return reduce(DataFrame.unionByName, rows)


@P.add("load_index", FOUND_IN_TITLES, "q a")
def load_index(t: Tables) -> DataFrame:
    """A saved index of two fields, loaded with one of them, searched from its files."""
    path = folder(t, "index")
    indexed(t).save(path)
    engine = SearchEngine.load(t.spark, path, fields=["Title"])
    return engine.search(SEARCHED, "swing, java", 20).select("rank", "PostId", "sim", "link")


_LOG = ["#batch epochs accuracy", "20 5 0.91", "40 5 0.93", "", "#dropout accuracy", "0.6 0.94"]


@P.add("param_result_parse", "SELECT * FROM (VALUES (1, '20|5|0.91'), (1, '40|5|0.93'), (2, '0.6|0.94')) v(section, row)")
def param_result_parse(t: Tables) -> DataFrame:
    lines = t.spark.createDataFrame([(0, i, x) for i, x in enumerate(_LOG)], "doc int, pos int, line string")
    return R.parameter_log(lines).select(F.col("section").cast("int").alias("section"), F.array_join("values", "|").alias("row"))


QUERIES, SQL = P.QUERIES, P.SQL
