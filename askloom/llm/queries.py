"""The pN_ queries of the operators in this folder, over whole tables, and their SQL where SQL is quick enough."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.cooccur import pair_surprise
from askloom.llm.distinctive import distinctive_terms, top_terms
from askloom.llm.knn import most_similar
from askloom.llm.markup import UNITS, clean_markup
from askloom.llm.mixing import mix
from askloom.llm.neardup import near_duplicates
from askloom.llm.packing import pack
from askloom.llm.repetition import repetition
from askloom.llm.tokens import token_count
from askloom.llm.topn import top_n
from askloom.operators.packed import TAGS, split_packed
from askloom.session import cut, once, once_wide, ready, table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one vector is among the other's 5 most similar at 0.8 or more, for TitleV and BodyV."""
    v = once(table(ready(spark), sf_dir, "vectors").select("PostId", "TitleV", "BodyV"), "PostId")
    parts = []
    for name in ("TitleV", "BodyV"):
        near = most_similar(v, "PostId", name, k=5, floor=0.8)
        pair = near.select(F.lit(name).alias("field"), F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))
        parts.append(pair.distinct())
    return parts[0].unionByName(parts[1])


def _tag_pairs(spark: SparkSession, sf_dir: str, lift: float | None = None) -> DataFrame:
    tags = split_packed(once(table(ready(spark), sf_dir, "questions").select("Id", "Tags")), "Id", {"Tags": TAGS})
    # a question's tags come from one field, so this array is no longer than that field
    return pair_surprise(cut(tags.groupBy("id").agg(F.collect_set(F.lower("item")).alias("tags"))), "tags", lift)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag pairs on two questions and a thousandth of all at least, three times as often as independence gives: those
    that surprise enough for it, checked by their counts."""
    found = _tag_pairs(spark, sf_dir, lift=3.0).where("together >= 2 and 1000 * together >= baskets and together * baskets >= 3 * n_a * n_b")
    return found.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag pair with its counts, expectation, surprise and false-discovery rate."""
    d = _tag_pairs(spark, sf_dir)
    return d.select("item_a", "item_b", "together", "n_a", "n_b", *(F.round(c, 6).alias(c) for c in ("expected", "lift", "surprise", "q")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of questions whose words are mostly the same; every pair of a group of copies, however large."""
    q = once_wide(table(ready(spark), sf_dir, "questions").select("Id", "Title", "Body"))
    return near_duplicates(q, "Id", "Title", "Body", 0.57, expand=None).select("id_a", "id_b")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's highest tf * ln(questions / df) term, where at most 5 questions hold it: of the terms enriched
    enough for it after adjustment, chosen by their counts."""
    q = once_wide(table(ready(spark), sf_dir, "questions").select("Id", "Title", "Body"))
    return top_terms(q, "Id", ["Title", "Body"], 5).select("id", "term")


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's terms with enrichment of at most 1 in 1000 after adjustment."""
    q = once_wide(table(ready(spark), sf_dir, "questions").select("Id", "Title", "Body"))
    rows, _ = distinctive_terms(q, "Id", ["Title", "Body"])
    return rows.where("q <= 0.001").select("id", "term", "tf", "df", F.round("score", 6).alias("score"), F.round("q", 9).alias("q"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best answers of every ParentId."""
    found = top_n(table(ready(spark), sf_dir, "answers"), "ParentId", "Score", "Id", 3)
    return found.select(F.col("group_key").alias("parent_id"), F.col("item_id").alias("answer_id"))


_TEXTS = (("questions", "Body"), ("answers", "Body"), ("comments", "Text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every structural unit of the three kinds of text. Copies of a row meet as counts, so no text is shuffled."""
    parts = []
    for name, text in _TEXTS:
        counts = clean_markup(table(ready(spark), sf_dir, name).where("Id is not null"), "Id", text, with_text=False)
        counts = counts.groupBy("id").agg(*(F.max(u).alias(u) for u in UNITS))
        parts.append(counts.select(F.lit(name).alias("tbl"), "*"))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    units = F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("n")) for u in UNITS))
    rows = rows.select("tbl", "id", F.explode(units).alias("u")).where("u.n > 0")
    return rows.select("tbl", "id", F.col("u.unit").alias("unit"), F.explode(F.sequence(F.lit(1), F.col("u.n"))).alias("pos"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text and number of units of every text of the three kinds."""
    parts = []
    for name, text in _TEXTS:
        rows = once_wide(table(ready(spark), sf_dir, name).select("Id", text))
        parts.append(clean_markup(rows, "Id", text).select(F.lit(name).alias("tbl"), "id", "clean", *UNITS))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of every plan's capacity, sizes in tokens."""
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))
    plans = {r["plan_id"]: r["capacity_tokens"] for r in table(spark, sf_dir, "pack_plans").select("plan_id", "capacity_tokens").distinct().collect()}
    return pack(docs, "doc_id", "tokens", plans).withColumnRenamed("id", "doc_id")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "source", token_count(F.col("text")).alias("tokens"))
    rows = table(spark, sf_dir, "mix_targets").where("source is not null").distinct().collect()
    return mix(docs, "doc_id", "source", "tokens", {r["source"].strip().lower(): (r["target_share"], r["max_repeats"]) for r in rows})


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents used and how often, so that the sources of mix_targets take their shares of all tokens."""
    return _mixed(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source in mix_targets."""
    return _mixed(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least a third of their words repeated: the band rejects those that cannot, the share decides."""
    rows = repetition(table(ready(spark), sf_dir, "documents"), "doc_id", "text")
    return rows.where("band = 'repetitive' and 3 * repeated >= words and words > 0").select(F.col("id").alias("doc_id"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, repeated words and their share."""
    rows = repetition(table(ready(spark), sf_dir, "documents"), "doc_id", "text", every=True)
    return rows.select(F.col("id").alias("doc_id"), "words", "repeated", F.round("share", 6).alias("share"))


QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_terms": p5_terms,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_clean": p7_clean,
    "p8_windows": p8_windows,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_shares": p10_shares,
}

_REPEATED = """
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS gram FROM w, LATERAL unnest(range(1, len(ws) - 3)) AS t(i)),
        r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) > 1),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS repeated FROM r, range(0, 5) AS s(k) GROUP BY doc_id),
        x AS (SELECT w.doc_id, coalesce(len(ws), 0) AS words, coalesce(repeated, 0) AS repeated FROM w LEFT JOIN c USING (doc_id))"""

SQL: dict[str, str] = {
    "p2_found": """
        WITH v AS (SELECT DISTINCT ON (PostId) * FROM vectors WHERE PostId IS NOT NULL),
        x AS (SELECT 'TitleV' AS field, PostId AS id, TitleV::DOUBLE[] AS vec FROM v UNION ALL SELECT 'BodyV', PostId, BodyV::DOUBLE[] FROM v),
        y AS (SELECT * FROM x WHERE len(vec) = 128 AND list_sum(list_transform(vec, lambda z: z * z)) > 0),
        s AS (SELECT a.field, a.id, b.id AS other, round(list_cosine_similarity(a.vec, b.vec), 6) AS sim FROM y a JOIN y b ON a.field = b.field AND a.id <> b.id),
        t AS (SELECT * FROM s WHERE sim >= 0.8 QUALIFY row_number() OVER (PARTITION BY field, id ORDER BY sim DESC, other) <= 5)
        SELECT DISTINCT field, least(id, other) AS id_a, greatest(id, other) AS id_b FROM t""",
    "p5_found": """
        WITH q AS (SELECT DISTINCT ON (Id) Id, Title, Body FROM questions WHERE Id IS NOT NULL),
        t AS (SELECT Id, unnest(list_concat(regexp_extract_all(lower(coalesce(Title, '')), '[a-z]{3,}'), regexp_extract_all(lower(coalesce(Body, '')), '[a-z]{3,}'))) AS term FROM q),
        f AS (SELECT Id, term, count(*) AS tf FROM t GROUP BY ALL),
        d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
        s AS (SELECT Id, term, df, tf * ln((SELECT count(*) FROM q)::DOUBLE / df) AS s FROM f JOIN d USING (term)
              QUALIFY row_number() OVER (PARTITION BY Id ORDER BY s DESC, term) = 1)
        SELECT Id AS id, term FROM s WHERE df <= 5""",
    "p10_found": _REPEATED + " SELECT doc_id FROM x WHERE 3 * repeated >= words AND words > 0",
    "p10_shares": _REPEATED + " SELECT doc_id, words, repeated, round(CASE WHEN words > 0 THEN repeated / words ELSE 0 END, 6) AS share FROM x",
    "p6_found": """
        SELECT ParentId AS parent_id, Id AS answer_id
        FROM (SELECT DISTINCT ParentId, Id, Score FROM answers WHERE ParentId IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY ParentId ORDER BY Score DESC NULLS LAST, Id) <= 3""",
}
