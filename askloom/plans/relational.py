"""Queries of selections, joins, aggregations, windows, sorts and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions.html import extract_parts
from askloom.functions.tokens import post_tokens
from askloom.operators import relational as R
from askloom.plans.base import Part, Tables, code_parts_sql
from askloom.session import cut, shared_folder

P = Part()
# The columns of a question that are kept.
_QCOLS = ["Id", "AcceptedAnswerId", "Title", "Body", "Tags", "Score", "FavoriteCount", "ViewCount", "AnswerCount", "CommentCount", "OwnerUserId", "CreationDate", "LastEditDate"]
_JAVA = "(Tags ILIKE '%java%' OR Tags ILIKE '%swing%') AND Tags NOT ILIKE '%javascript%'"


def _java(t: Tables, *cols: str) -> DataFrame:
    return t.q("Tags", *cols).where(R.tag_filter(F.col("Tags"), ["java", "swing"], ["javascript"]))


@P.add("filter_java_questions", f"SELECT Id FROM q WHERE {_JAVA}", "q")
def filter_java_questions(t: Tables) -> DataFrame:
    return _java(t).select("Id")


_QSQL = ", ".join(f"{c} AT TIME ZONE 'UTC' AS {c}" if c.endswith("Date") else c for c in _QCOLS)


@P.add("project_questions", f"SELECT {_QSQL} FROM q WHERE {_JAVA}", "q")
def project_questions(t: Tables) -> DataFrame:
    return _java(t, *[c for c in _QCOLS if c not in ("Id", "Tags")]).select(*_QCOLS)


@P.add("filter_questions_quality", "SELECT Id FROM q WHERE AnswerCount >= 1 AND Score >= -3", "q")
def filter_questions_quality(t: Tables) -> DataFrame:
    return t.q("AnswerCount", "Score").where(R.all_of(["AnswerCount >= 1", "Score >= -3"])).select("Id")


# The conditions of posts that are indexed.
_INDEX = ["AcceptedAnswerId NOT NULL", "Score >= 1", "AnswerCount >= 1", "SnippetCount >= 1"]
_INDEX_SQL = "AcceptedAnswerId IS NOT NULL AND Score >= 1 AND AnswerCount >= 1 AND SnippetCount >= 1"


def index_posts(t: Tables, *cols: str) -> DataFrame:
    need = dict.fromkeys(["AcceptedAnswerId", "Score", "AnswerCount", "SnippetCount", *cols])
    return t.q(*need).where(R.all_of(_INDEX))


@P.add("filter_index_posts", f"SELECT Id FROM q WHERE {_INDEX_SQL}", "q")
def filter_index_posts(t: Tables) -> DataFrame:
    return index_posts(t).select("Id")


@P.add("scan_ids", f"SELECT Id FROM q WHERE {_INDEX_SQL}", "q")
def scan_ids(t: Tables) -> DataFrame:
    return index_posts(t).select("Id")


@P.add("project_metadata", f"SELECT Id, Score, Title, Tags, Entities, SnippetCount, Snippets FROM q WHERE {_INDEX_SQL}", "q")
def project_metadata(t: Tables) -> DataFrame:
    return index_posts(t, "Title", "Tags", "Entities", "Snippets").select("Id", "Score", "Title", "Tags", "Entities", "SnippetCount", "Snippets")


# Words whose posts are offered for labelling.
_WORDS = ["exception", "debug", "error", "fail", "warning"]


@P.add(
    "scan_posts_for_labelling",
    "SELECT Id FROM q WHERE (" + " OR ".join(f"Title ILIKE '%{w}%'" for w in _WORDS) + ") AND Body NOT ILIKE '%</pre>%' AND length(Body) - length(replace(Body, ' ', '')) + 1 >= 150",
    "q",
)
def scan_posts_for_labelling(t: Tables) -> DataFrame:
    spaces = F.length("Body") - F.length(F.replace(F.col("Body"), F.lit(" "), F.lit(""))) + 1
    return t.q("Title", "Body").where(R.tag_filter(F.col("Title"), _WORDS) & ~F.col("Body").ilike("%</pre>%") & (spaces >= 150)).select("Id")


@P.add("rename_column", "SELECT Id, Text AS Body, PostId FROM c", "c")
def rename_column(t: Tables) -> DataFrame:
    return t.c("Text", "PostId").select("Id", F.col("Text").alias("Body"), "PostId")


@P.add("filter_by_mask", "SELECT q.Id, Title FROM q JOIN (SELECT Id, Score >= 2 AS keep FROM q) m ON q.Id = m.Id WHERE keep", "q")
def filter_by_mask(t: Tables) -> DataFrame:
    mask = t.q("Score").select("Id", (F.col("Score") >= 2).alias("keep"))
    return t.q("Title").join(mask, "Id").where("keep").select("Id", "Title")


@P.add("filter_min_snippets", "SELECT Id, SnippetCount FROM q WHERE SnippetCount >= 1", "q")
def filter_min_snippets(t: Tables) -> DataFrame:
    return t.q("SnippetCount").where("SnippetCount >= 1").select("Id", "SnippetCount")


_STOP = ["the", "a", "an", "to", "of", "and", "in", "on", "is", "my", "our", "how", "with", "this", "that", "i", "for"]
_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in _STOP) + ")"
_TITLE_TOKENS = r"SELECT Id, unnest(regexp_extract_all(lower(Title), '[^ \t\n\r\f\x0B]+')) AS token FROM q WHERE Title IS NOT NULL"


def title_tokens(t: Tables) -> DataFrame:
    """(Id, pos, token) of titles in lower case."""
    words = F.regexp_extract_all(F.lower("Title"), F.lit(r"([^ \t\n\r\f\x0B]+)"), F.lit(1))
    return t.q("Title").where("Title is not null").select("Id", F.posexplode(words).alias("pos", "token"))


@P.add("filter_stop_words", f"WITH k AS ({_TITLE_TOKENS}) SELECT Id, token FROM k WHERE token NOT IN {_STOP_SQL} AND length(token) > 1 AND NOT regexp_full_match(token, '[-+]?[0-9]+')", "q")
def filter_stop_words(t: Tables) -> DataFrame:
    keep = ~F.col("token").isin(_STOP) & (F.length("token") > 1) & ~F.col("token").rlike(r"^[-+]?[0-9]+\z")
    return title_tokens(t).where(keep).select("Id", "token")


@P.add("filter_tags_any", "WITH g AS (SELECT Id, Score, list_distinct(regexp_extract_all(lower(Tags), '[a-z0-9][a-z0-9.#+-]*')) AS tags FROM q), r AS (SELECT Id, Score FROM g WHERE list_has_any(tags, ['swing', 'json', 'no-such-tag'])) SELECT Id, row_number() OVER (ORDER BY Score DESC NULLS LAST, Id) AS rank FROM r QUALIFY rank <= 20", "q")
def filter_tags_any(t: Tables) -> DataFrame:
    """The tag filter runs below the ranking, which is a top-20."""
    tags = F.regexp_extract_all(F.lower("Tags"), F.lit("([a-z0-9][a-z0-9.#+-]*)"), F.lit(1))
    wanted = F.array(*map(F.lit, ["swing", "json", "no-such-tag"]))
    hits = t.q("Tags", "Score").where(F.arrays_overlap(tags, wanted))
    top = hits.orderBy(F.desc_nulls_last("Score"), "Id").limit(20)
    return top.select("Id", F.row_number().over(Window.orderBy(F.desc_nulls_last("Score"), "Id")).cast("long").alias("rank"))


@P.add("filter_unspecified", "WITH h AS (SELECT q.Id, coalesce(min(tag) FILTER (tag IN ('swing', 'json', 'sql')), 'unspecified') AS mark FROM q LEFT JOIN tag USING (Id) GROUP BY q.Id) SELECT Id, mark FROM h WHERE mark <> 'unspecified'", "q tag")
def filter_unspecified(t: Tables) -> DataFrame:
    marked = t.tags().where(F.col("tag").isin("swing", "json", "sql")).groupBy("Id").agg(F.min("tag").alias("mark"))
    return t.q().join(marked, "Id", "left").withColumn("mark", F.coalesce("mark", F.lit("unspecified"))).where("mark <> 'unspecified'")


@P.add(
    "highlight_tag",
    "WITH n AS (SELECT q.Id, count(tag) AS n, min(tag) FILTER (tag IN ('swing', 'json', 'sql')) AS hit, string_agg(tag, ' ' ORDER BY tag) AS every FROM q LEFT JOIN tag USING (Id) GROUP BY q.Id) SELECT Id, CASE WHEN hit IS NOT NULL AND n <= 5 THEN hit ELSE coalesce(every, '') END AS label FROM n",
    "q tag",
)
def highlight_tag(t: Tables) -> DataFrame:
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("Tags", F.lit(""))), F.lit("([a-z0-9][a-z0-9.#+-]*)"), F.lit(1))))
    hit = F.array_intersect(tags, F.array(*map(F.lit, ["json", "sql", "swing"])))
    return t.q("Tags").select("Id", F.when((F.size(hit) > 0) & (F.size(tags) <= 5), F.array_min(hit)).otherwise(F.array_join(tags, " ")).alias("label"))


# joins


@P.add("semi_join_answers", f"SELECT Id FROM a WHERE ParentId IN (SELECT Id FROM q WHERE {_JAVA})", "q a")
def semi_join_answers(t: Tables) -> DataFrame:
    return R.semi(t.a("ParentId"), "ParentId", _java(t).select("Id")).select("Id")


_KEPT = f"k AS (SELECT Id FROM q WHERE {_JAVA}), ka AS (SELECT Id FROM a WHERE ParentId IN (SELECT Id FROM k))"


def _kept(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = _java(t).select("Id")
    return k, R.semi(t.a("ParentId"), "ParentId", k).select("Id")


@P.add("semi_join_comments", f"WITH {_KEPT} SELECT Id FROM c WHERE PostId IN (SELECT Id FROM k UNION ALL SELECT Id FROM ka)", "q a c")
def semi_join_comments(t: Tables) -> DataFrame:
    k, ka = _kept(t)
    return R.semi(t.c("PostId"), "PostId", k.unionAll(ka)).select("Id")


@P.add("semi_join_corpus_scopes", f"WITH {_KEPT} SELECT 'answer' AS scope, Id FROM ka UNION ALL SELECT 'comment', Id FROM c WHERE PostId IN (SELECT Id FROM k UNION ALL SELECT Id FROM ka)", "q a c")
def semi_join_corpus_scopes(t: Tables) -> DataFrame:
    k, ka = _kept(t)
    comments = R.semi(t.c("PostId"), "PostId", k.unionAll(ka)).select(F.lit("comment").alias("scope"), "Id")
    return ka.select(F.lit("answer").alias("scope"), "Id").unionAll(comments)


@P.add("union_all_ids", f"WITH {_KEPT} SELECT Id FROM k UNION ALL SELECT Id FROM ka", "q a")
def union_all_ids(t: Tables) -> DataFrame:
    k, ka = _kept(t)
    return k.unionAll(ka)


@P.add("semi_join_both_endpoints", "SELECT Id, PostId, RelatedPostId FROM l WHERE PostId IN (SELECT Id FROM q) AND RelatedPostId IN (SELECT Id FROM q)", "q l")
def semi_join_both_endpoints(t: Tables) -> DataFrame:
    return R.both_ends(t.l("PostId", "RelatedPostId"), "PostId", "RelatedPostId", t.q()).select("Id", "PostId", "RelatedPostId")


_PAIRS = "SELECT DISTINCT PostId, RelatedPostId FROM l WHERE PostId IN (SELECT Id FROM q) AND RelatedPostId IN (SELECT Id FROM q)"


@P.add("linked_pairs", _PAIRS, "q l")
@P.add("distinct_pairs", _PAIRS, "q l")
def linked_pairs(t: Tables) -> DataFrame:
    return R.both_ends(t.l("PostId", "RelatedPostId"), "PostId", "RelatedPostId", t.q()).select("PostId", "RelatedPostId").distinct()


@P.add("linked_pairs_greedy")
def linked_pairs_greedy(t: Tables) -> DataFrame:
    return R.greedy_pairs(linked_pairs(t), "PostId", "RelatedPostId").select(F.col("s").alias("PostId"), F.col("d").alias("RelatedPostId"))


@P.add("join_extra_columns", f"SELECT Id, SnippetCount, Entities FROM q WHERE {_JAVA}", "q")
def join_extra_columns(t: Tables) -> DataFrame:
    return _java(t).select("Id").join(t.q("SnippetCount", "Entities"), "Id", "inner").select("Id", "SnippetCount", "Entities")


@P.add(
    "join_question_answers",
    "SELECT Id AS qid, 0 AS part, 0::BIGINT AS at, Title AS line FROM q WHERE Title IS NOT NULL UNION ALL SELECT Id, 1, 0, Body FROM q WHERE Body IS NOT NULL UNION ALL SELECT ParentId, 2, a.Id, a.Body FROM a WHERE a.Body IS NOT NULL AND ParentId IN (SELECT Id FROM q)",
    "q a",
)
def join_question_answers(t: Tables) -> DataFrame:
    """One corpus line per title, body and answer; order by (qid, part, at) only where it is written."""
    q = t.q("Title", "Body")
    zero = F.lit(0).cast("long")
    head = q.select(F.col("Id").alias("qid"), F.lit(0).alias("part"), zero.alias("at"), F.col("Title").alias("line"))
    body = q.select(F.col("Id").alias("qid"), F.lit(1).alias("part"), zero.alias("at"), F.col("Body").alias("line"))
    answers = R.semi(t.a("ParentId", "Body"), "ParentId", q.select("Id"))
    tail = answers.select(F.col("ParentId").alias("qid"), F.lit(2).alias("part"), F.col("Id").alias("at"), F.col("Body").alias("line"))
    return head.unionAll(body).unionAll(tail).where("line is not null")


_CONCAT = "SELECT ParentId, string_agg(Body, ' ' ORDER BY Id) AS bodies FROM a WHERE ParentId IS NOT NULL AND Body IS NOT NULL GROUP BY ParentId"


def concat_bodies(t: Tables) -> DataFrame:
    """Texts of a question's answers in id order. The output row holds them all, so the group meets in one place."""
    rows = t.a("ParentId", "Body").where("ParentId is not null and Body is not null")
    texts = F.array_sort(F.collect_list(F.struct("Id", "Body")))
    return rows.groupBy("ParentId").agg(F.array_join(F.transform(texts, lambda x: x["Body"]), " ").alias("bodies"))


@P.add("concat_bodies_per_post", _CONCAT, "a")
def concat_bodies_per_post(t: Tables) -> DataFrame:
    return concat_bodies(t)


@P.add("left_join_bodies", f"SELECT Id, coalesce(Body, '') || ' ' || coalesce(bodies, '') AS post FROM q LEFT JOIN ({_CONCAT}) b ON q.Id = b.ParentId", "q a")
def left_join_bodies(t: Tables) -> DataFrame:
    joined = t.q("Body").join(concat_bodies(t), F.col("Id") == F.col("ParentId"), "left")
    return joined.select("Id", F.concat(F.coalesce("Body", F.lit("")), F.lit(" "), F.coalesce("bodies", F.lit(""))).alias("post"))


_CODES = f"SELECT ParentId, Id, Score, {code_parts_sql('Body')} AS s FROM a WHERE ParentId IS NOT NULL AND Body IS NOT NULL"
_SNIPS = f"WITH k AS ({_CODES}), g AS (SELECT ParentId, sum(len(s))::BIGINT AS SnippetCount, string_agg('Post: https://qa.example/questions/' || Id || chr(10) || '##Score ' || coalesce(Score, 0) || chr(10) || array_to_string(s, '<_code_>'), '<_post_>' ORDER BY Score DESC NULLS LAST, Id) AS Snippets FROM k WHERE len(s) > 0 GROUP BY ParentId)"


def coded_answers(t: Tables) -> DataFrame:
    rows = t.a("ParentId", "Score", "Body").where("ParentId is not null and Body is not null")
    return rows.select("Id", "ParentId", "Score", extract_parts(F.col("Body")).alias("codes"))


def snippets_of(t: Tables) -> DataFrame:
    return R.snippet_index(coded_answers(t), "ParentId", "Id", "Score", "codes", "https://qa.example/questions/")


@P.add("agg_snippets", _SNIPS + " SELECT * FROM g", "a")
def agg_snippets(t: Tables) -> DataFrame:
    return snippets_of(t)


@P.add("snippet_block", f"WITH k AS ({_CODES}) SELECT Id, 'Post: https://qa.example/questions/' || Id || chr(10) || '##Score ' || Score || chr(10) || array_to_string(s, '<_code_>') AS block FROM k WHERE len(s) > 0 AND Score IS NOT NULL", "a")
def snippet_block(t: Tables) -> DataFrame:
    from askloom.functions.text import snippet_block as block

    rows = coded_answers(t).where((F.size("codes") > 0) & F.col("Score").isNotNull())
    return rows.select("Id", block(F.col("Id"), F.col("Score"), F.col("codes"), "https://qa.example/questions/").alias("block"))


_WIDER = _SNIPS + " SELECT q.Id, Title, coalesce(g.SnippetCount, 0) AS SnippetCount, coalesce(g.Snippets, '') AS Snippets FROM q LEFT JOIN g ON q.Id = g.ParentId"


@P.add("left_join_snippets", _WIDER, "q a")
def left_join_snippets(t: Tables) -> DataFrame:
    joined = t.q("Title").join(snippets_of(t), F.col("Id") == F.col("ParentId"), "left")
    return joined.select("Id", "Title", F.coalesce("SnippetCount", F.lit(0)).alias("SnippetCount"), F.coalesce("Snippets", F.lit("")).alias("Snippets"))


@P.add("alter_add_columns", _WIDER, "q a")
def alter_add_columns(t: Tables) -> DataFrame:
    """A stored table gets wider: the new table is written beside the old one, which stays until readers have moved."""
    place = f"{shared_folder(t.spark).rstrip('/')}/alter-{uuid.uuid4().hex}"
    t.q("Title").write.parquet(f"{place}/old")
    joined = t.spark.read.parquet(f"{place}/old").join(snippets_of(t), F.col("Id") == F.col("ParentId"), "left")
    joined.select("Id", "Title", F.coalesce("SnippetCount", F.lit(0)).alias("SnippetCount"), F.coalesce("Snippets", F.lit("")).alias("Snippets")).write.parquet(f"{place}/new")
    return t.spark.read.parquet(f"{place}/new")


@P.add("semi_join_index_dataset", f"SELECT Id, Title, Body FROM q WHERE Body IS NOT NULL AND Id IN (SELECT Id FROM q WHERE {_INDEX_SQL})", "q")
def semi_join_index_dataset(t: Tables) -> DataFrame:
    return R.semi(t.q("Title", "Body").where("Body is not null"), "Id", index_posts(t).select("Id"))


@P.add("lookup_join_metadata", "WITH r AS (SELECT Id, row_number() OVER (ORDER BY ViewCount DESC, Id) AS rank FROM q QUALIFY rank <= 20) SELECT r.rank, q.Id, q.Title, q.SnippetCount FROM r JOIN q ON q.Id = r.Id", "q")
def lookup_join_metadata(t: Tables) -> DataFrame:
    top = t.q("ViewCount").orderBy(F.desc("ViewCount"), "Id").limit(20)  # twenty rows: the broadcast side
    top = top.select("Id", F.row_number().over(Window.orderBy(F.desc("ViewCount"), "Id")).cast("long").alias("rank"))
    return t.q("Title", "SnippetCount").join(F.broadcast(top), "Id").select("rank", "Id", "Title", "SnippetCount")


# aggregations


@P.add("count_all", "SELECT count(*) AS n FROM q", "q")
def count_all(t: Tables) -> DataFrame:
    return t.q().agg(F.count("*").alias("n"))


_FREQ = f"WITH k AS ({_TITLE_TOKENS}) SELECT token, count(*) AS n FROM k GROUP BY token"


def frequencies(t: Tables) -> DataFrame:
    return title_tokens(t).groupBy("token").agg(F.count("*").alias("n"))


@P.add("token_frequencies", _FREQ, "q")
def token_frequencies(t: Tables) -> DataFrame:
    return frequencies(t)


@P.add("sort_frequencies", _FREQ, "q")
def sort_frequencies(t: Tables) -> DataFrame:
    """Every token, most frequent first: a range sort, no single task."""
    return frequencies(t).orderBy(F.desc("n"), "token")


@P.add("distinct_tags", "SELECT DISTINCT tag FROM tag", "tag")
def distinct_tags(t: Tables) -> DataFrame:
    return t.tags().select("tag").distinct()


@P.add("inverted_index", "SELECT tag, Id // 1048576 AS block, string_agg(Id, ' ' ORDER BY Id) AS ids FROM tag GROUP BY ALL", "tag")
def inverted_index(t: Tables) -> DataFrame:
    """The sorted ids of every tag in blocks of 2^20 ids, so that a tag of a third of all posts is built by many tasks."""
    return R.postings(t.tags(), "Id", "tag").select("tag", "block", F.concat_ws(" ", F.col("ids").cast("array<string>")).alias("ids"))


_TOP = "WITH r AS (SELECT Id, row_number() OVER (ORDER BY ViewCount DESC, Id) AS rank, regexp_extract_all(lower(Tags), '[a-z0-9][a-z0-9.#+-]*') AS tags FROM q WHERE Tags IS NOT NULL QUALIFY rank <= 100), x AS (SELECT rank, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM r), g AS (SELECT tag, count(*) AS n, min(rank * 100000 + pos) AS f FROM x GROUP BY tag) SELECT tag, n FROM g ORDER BY n DESC, f LIMIT 8"


@P.add("top_tags", _TOP, "q")
def top_tags(t: Tables) -> DataFrame:
    tags = F.regexp_extract_all(F.lower("Tags"), F.lit("([a-z0-9][a-z0-9.#+-]*)"), F.lit(1))
    top = t.q("Tags", "ViewCount").where("Tags is not null").orderBy(F.desc("ViewCount"), "Id").limit(100)
    ranked = top.select(F.row_number().over(Window.orderBy(F.desc("ViewCount"), "Id")).alias("rank"), tags.alias("tags"))
    return R.top_tags(ranked, "rank", "tags")


@P.add("degree_count", "SELECT id, count(*) AS degree FROM (SELECT PostId AS id FROM l UNION ALL SELECT RelatedPostId FROM l) WHERE id IS NOT NULL GROUP BY id", "l")
def degree_count(t: Tables) -> DataFrame:
    return R.degrees(t.l("PostId", "RelatedPostId"), "PostId", "RelatedPostId")


@P.add("filter_min_degree", "SELECT id FROM (SELECT PostId AS id FROM l UNION ALL SELECT RelatedPostId FROM l) WHERE id IS NOT NULL GROUP BY id HAVING count(*) >= 3", "l")
def filter_min_degree(t: Tables) -> DataFrame:
    return R.degrees(t.l("PostId", "RelatedPostId"), "PostId", "RelatedPostId").where("degree >= 3").select("id")


@P.add("union_symmetric_pairs", "SELECT PostId AS src, RelatedPostId AS dst FROM l WHERE PostId IS NOT NULL AND RelatedPostId IS NOT NULL UNION SELECT RelatedPostId, PostId FROM l WHERE PostId IS NOT NULL AND RelatedPostId IS NOT NULL", "l")
def union_symmetric_pairs(t: Tables) -> DataFrame:
    return R.symmetric(t.l("PostId", "RelatedPostId"), "PostId", "RelatedPostId")


_LOOKUP = "i AS (SELECT PostId AS s, RelatedPostId AS d FROM l WHERE PostId IN (SELECT Id FROM q) AND RelatedPostId IN (SELECT Id FROM q)), b AS (SELECT n FROM (SELECT s AS n FROM i UNION ALL SELECT d FROM i) GROUP BY n HAVING count(*) >= 2), k AS (SELECT s, d FROM i WHERE s IN (SELECT n FROM b) AND d IN (SELECT n FROM b)), lk AS (SELECT s AS src, d AS dst FROM k UNION SELECT d, s FROM k)"


def lookup(t: Tables) -> DataFrame:
    return R.link_lookup(t.l("PostId", "RelatedPostId"), "PostId", "RelatedPostId", t.q(), 2)


@P.add("postlink_lookup", f"WITH {_LOOKUP} SELECT src, dst FROM lk", "q l")
def postlink_lookup(t: Tables) -> DataFrame:
    return lookup(t)


@P.add("word_index", r"WITH w AS (SELECT Id, regexp_extract_all(lower(Title), '[^ \t\n\r\f\x0B]+') AS ws FROM q WHERE Title IS NOT NULL), k AS (SELECT Id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM w), g AS (SELECT token, count(*) AS n, min(Id * 100000 + pos) AS f FROM k GROUP BY token) SELECT token, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM g", "q")
def word_index(t: Tables) -> DataFrame:
    return R.rank_words(title_tokens(t), "Id", "pos", "token")


#: Size of the dictionary, whose last code stands for unknown tokens, and length of a sequence.
_DICTIONARY, _LENGTH = 12_000, 4_000
_IDS = rf"""WITH w AS (SELECT Id, regexp_extract_all(regexp_replace(lower(concat_ws(' ', Title, Body)), ':[0-9]*\)', ':_xerrx_)', 'g'), '[\p{{L}}\p{{N}}_]{{2,}}|[|&#@~_''\"=\\/\-:;*.$()\[\]{{}}]') AS ws FROM q WHERE Title IS NOT NULL OR Body IS NOT NULL),
    k AS (SELECT Id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM w), g AS (SELECT token, count(*) AS n, min(Id::HUGEINT * 100000000 + pos) AS f FROM k GROUP BY token),
    x AS (SELECT token, row_number() OVER (ORDER BY n DESC, f) AS rank FROM g), y AS (SELECT Id, pos, CASE WHEN rank < {_DICTIONARY} THEN rank ELSE {_DICTIONARY - 1} END AS code FROM k JOIN x USING (token))"""


def post_codes(t: Tables) -> DataFrame:
    """(Id, pos, code): dictionary rank of each token of a post, at most the dictionary's last code, which unknown tokens
    have. The dictionary has at most _DICTIONARY rows and is the broadcast side."""
    rows = t.q("Title", "Body").where("Title is not null or Body is not null")
    tokens = cut(rows.select("Id", F.posexplode(post_tokens(F.concat_ws(" ", "Title", "Body"))).alias("pos", "token")))
    words = R.rank_words(tokens, "Id", "pos", "token").where(F.col("rank") < _DICTIONARY).select("token", "rank")
    return tokens.join(F.broadcast(words), "token", "left").select("Id", "pos", F.coalesce("rank", F.lit(_DICTIONARY - 1)).alias("code"))


def _sequences(codes: DataFrame) -> DataFrame:
    return codes.groupBy("Id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("seq"))


@P.add("vectorize_tokens", _IDS + " SELECT Id, string_agg(code, ' ' ORDER BY pos) AS seq FROM y GROUP BY Id", "q")
def vectorize_tokens(t: Tables) -> DataFrame:
    return _sequences(post_codes(t)).select("Id", F.concat_ws(" ", F.col("seq").cast("array<string>")).alias("seq"))


@P.add("filter_top_tokens", _IDS + f" SELECT Id, string_agg(code, ' ' ORDER BY pos) AS seq FROM y WHERE code < {_DICTIONARY - 1} GROUP BY Id", "q")
def filter_top_tokens(t: Tables) -> DataFrame:
    """Sequences of known tokens only."""
    seq = F.filter("seq", lambda x: x < _DICTIONARY - 1)
    return _sequences(post_codes(t)).select("Id", seq.alias("seq")).where(F.size("seq") > 0).select("Id", F.concat_ws(" ", F.col("seq").cast("array<string>")).alias("seq"))


@P.add("pad_sequence", _IDS + f", z AS (SELECT Id, list(code ORDER BY pos) AS s FROM y GROUP BY Id) SELECT Id, array_to_string(list_concat(list_resize([]::BIGINT[], greatest(0, {_LENGTH} - len(s)), 0), s[greatest(1, len(s) - {_LENGTH - 1}):]), ' ') AS seq FROM z", "q")
def pad_sequence(t: Tables) -> DataFrame:
    """The last _LENGTH codes, zeros on the left of shorter sequences."""
    seqs = _sequences(post_codes(t))
    last = F.slice("seq", F.greatest(F.lit(1), F.size("seq") - (_LENGTH - 1)), F.lit(_LENGTH))
    padded = F.concat(F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), _LENGTH - F.size("seq"))), last)
    return seqs.select("Id", F.concat_ws(" ", padded.cast("array<string>")).alias("seq"))


@P.add("document_frequency", f"WITH k AS ({_TITLE_TOKENS}) SELECT token, count(DISTINCT Id) AS df FROM k GROUP BY token", "q")
def document_frequency(t: Tables) -> DataFrame:
    return title_tokens(t).select("Id", "token").distinct().groupBy("token").agg(F.count("*").alias("df"))


# sorts, slices, sets


@P.add("order_by_id", "SELECT Id, CreationDate AT TIME ZONE 'UTC' AS CreationDate FROM q", "q")
def order_by_id(t: Tables) -> DataFrame:
    return t.q("CreationDate").orderBy("Id")


@P.add("order_by_score", "SELECT Id, Score FROM a", "a")
def order_by_score(t: Tables) -> DataFrame:
    return t.a("Score").orderBy(F.desc_nulls_last("Score"), "Id")


@P.add("topn_by_score", "SELECT Id, Score FROM a ORDER BY Score DESC NULLS LAST, Id LIMIT 400", "a")
def topn_by_score(t: Tables) -> DataFrame:
    return t.a("Score").orderBy(F.desc_nulls_last("Score"), "Id").limit(400)


@P.add("partition_slice", "SELECT Id, row_number() OVER (ORDER BY Id) AS row FROM q QUALIFY row BETWEEN 101 AND 220", "q")
def partition_slice(t: Tables) -> DataFrame:
    return R.number_rows(t.q(), [F.col("Id")]).where("row between 101 and 220").select("Id", "row")


@P.add("sort_by_position", r"SELECT Id, array_to_string(list_transform(list_sort(list_transform(range(1, len(w) + 1), lambda i: {'k': length(w[i]), 'i': i, 'w': w[i]})), lambda x: x.w), ' ') AS words FROM (SELECT Id, string_split(Title, ' ') AS w FROM q WHERE Title IS NOT NULL)", "q")
def sort_by_position(t: Tables) -> DataFrame:
    """Entries of one record by a position, here the word's length, stable in the order of arrival."""
    entries = F.transform(F.split("Title", " "), lambda w, i: F.struct(F.length(w).alias("k"), i.alias("i"), w.alias("w")))
    return t.q("Title").where("Title is not null").select("Id", F.array_join(F.transform(F.array_sort(entries), lambda x: x["w"]), " ").alias("words"))


@P.add("union_entity_parts", "SELECT Id, Entities FROM q WHERE Entities IS NOT NULL", "q")
def union_entity_parts(t: Tables) -> DataFrame:
    """Parts with disjoint keys come together again."""
    q = t.q("Entities").where("Entities is not null")
    return q.where("Id % 2 = 0").unionByName(q.where("Id % 2 <> 0"))


@P.add("union_tags_entities", r"WITH x AS (SELECT Id, list_distinct(list_filter(list_concat(regexp_extract_all(lower(coalesce(Tags, '')), '[a-z0-9][a-z0-9.#+-]*'), string_split(coalesce(Entities, ''), '<_ent_>')), lambda x: x <> '')) AS e FROM q) SELECT Id, array_to_string(list_sort(e), '|') AS etags FROM x", "q")
def union_tags_entities(t: Tables) -> DataFrame:
    tags = F.regexp_extract_all(F.lower(F.coalesce("Tags", F.lit(""))), F.lit("([a-z0-9][a-z0-9.#+-]*)"), F.lit(1))
    both = F.filter(F.array_union(tags, F.split(F.coalesce("Entities", F.lit("")), "<_ent_>")), lambda x: x != "")
    return t.q("Tags", "Entities").select("Id", F.array_join(F.array_sort(both), "|").alias("etags"))


@P.add("membership", "SELECT DISTINCT PostId, RelatedPostId FROM l WHERE (RelatedPostId, PostId) IN (SELECT PostId, RelatedPostId FROM l)", "l")
def membership(t: Tables) -> DataFrame:
    pairs = t.l("PostId", "RelatedPostId").select("PostId", "RelatedPostId").where("PostId is not null and RelatedPostId is not null").distinct()
    return pairs.intersect(pairs.select("RelatedPostId", "PostId"))


QUERIES, SQL = P.QUERIES, P.SQL
