"""Queries of tokenisers, source code and token features."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions import code as C
from askloom.functions import html as H
from askloom.functions import ner as N
from askloom.functions import tokens as T
from askloom.operators import chain as L
from askloom.plans.base import Part, Tables
from askloom.session import cut, kept, shared_folder
from askloom.sources import readers as R

P = Part()


def body(t: Tables) -> DataFrame:
    return t.q("Body").where("Body is not null")


def _per_body(name: str, column) -> None:
    P.add(name)(lambda t: body(t).select("Id", column(F.col("Body")).alias("value")))


for _name, _f in {
    "html_text": H.html_text,
    "html_extract_code": lambda c: F.array_join(H.extract_parts(c), "<_code_>"),
    "html_drop_pre": H.drop_element,
    "html_replace_pre": H.replace_pre,
    "code_tokenizer": lambda c: F.array_join(T.tokenize_code(c), " "),
    "norm_tokens": T.norm_text,
    "norm_corpus_ner": lambda c: T.norm_text(H.drop_element(c)),
    "lemma_tokens": T.lemma_text,
    "tok_social": lambda c: F.array_join(T.tokenize_social(c), " "),
}.items():
    _per_body(_name, _f)


@P.add("tok_align")
def tok_align(t: Tables) -> DataFrame:
    """Tokens with offsets; `fits` says that the text has the token there."""
    each = body(t).select("Id", "Body", F.explode(T.align_social(F.col("Body"))).alias("x")).select("Id", "Body", "x.*")
    return each.select("Id", "start", "token", (F.col("Body").substr(F.col("start") + 1, F.length("token")) == F.col("token")).alias("fits"))


@P.add("sentence_split")
def sentence_split(t: Tables) -> DataFrame:
    return body(t).select("Id", F.posexplode(T.sentences(H.html_text(F.col("Body")))).alias("pos", "sentence"))


@P.add("tok_post", r"SELECT Id, array_to_string(regexp_extract_all(regexp_replace(lower(Title), ':[0-9]*\)', ':_xerrx_)', 'g'), '[\p{L}\p{N}_]{2,}|[|&#@~_''\"=\\/\-:;*.$()\[\]{}]'), ' ') AS tokens FROM q WHERE Title IS NOT NULL", "q")
def tok_post(t: Tables) -> DataFrame:
    return t.q("Title").where("Title is not null").select("Id", F.array_join(T.post_tokens(F.col("Title")), " ").alias("tokens"))


_WORDS = r"SELECT Id, string_split(regexp_replace(trim(Title), '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ') AS ws FROM q WHERE trim(Title) <> ''"


def words(t: Tables) -> DataFrame:
    """(Id, ws): title words by white space."""
    clean = F.trim(F.regexp_replace(F.trim("Title"), r"[ \t\n\r\f\x0B]+", " "))
    return t.q("Title").where(F.trim("Title") != "").select("Id", F.split(clean, " ").alias("ws"))


def each_word(t: Tables) -> DataFrame:
    return words(t).select("Id", F.posexplode("ws").alias("pos", "token"))


_EACH = f"w AS ({_WORDS}), k AS (SELECT Id, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS pos FROM w), d AS (SELECT DISTINCT token FROM k)"
_BIGRAMS = f"WITH {_EACH}, b AS (SELECT Id, token || ' ' || lead(token) OVER (PARTITION BY Id ORDER BY pos) AS pair FROM k)"


@P.add("phrase_counts", _BIGRAMS + " SELECT pair, count(*) AS n FROM b WHERE pair IS NOT NULL GROUP BY pair", "q")
def phrase_counts(t: Tables) -> DataFrame:
    return words(t).select(F.explode(T.ngram_pairs(F.col("ws"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


_SCORED = _BIGRAMS + ", n AS (SELECT token, count(*) AS n FROM k GROUP BY token), p AS (SELECT pair, count(*) AS n FROM b WHERE pair IS NOT NULL GROUP BY pair) SELECT pair, round((p.n - 3) * (SELECT count(*) FROM n)::DOUBLE / (x.n * y.n), 6) AS score FROM p JOIN n x ON x.token = string_split(pair, ' ')[1] JOIN n y ON y.token = string_split(pair, ' ')[2] WHERE p.n >= 3 AND (p.n - 3) * (SELECT count(*) FROM n)::DOUBLE / (x.n * y.n) > 0.1"


@P.add("ngram_phrases", _SCORED, "q")
def ngram_phrases(t: Tables) -> DataFrame:
    """Collocations: (n_ab - min) * vocabulary / (n_a * n_b) above a threshold."""
    single = each_word(t).groupBy("token").agg(F.count("*").alias("n"))
    size = single.count()
    pairs = words(t).select(F.explode(T.ngram_pairs(F.col("ws"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).where("n >= 3")
    pairs = pairs.select("pair", "n", F.split("pair", " ")[0].alias("a"), F.split("pair", " ")[1].alias("b"))
    both = pairs.join(single.select(F.col("token").alias("a"), F.col("n").alias("na")), "a").join(single.select(F.col("token").alias("b"), F.col("n").alias("nb")), "b")
    score = (F.col("n") - 3) * F.lit(float(size)) / (F.col("na") * F.col("nb"))
    return both.where(score > 0.1).select("pair", F.round(score, 6).alias("score"))


# source code


def snippets(t: Tables) -> DataFrame:
    """(Id, pos, code): code parts of answers."""
    return t.a("Body").where("Body is not null").select("Id", F.posexplode(H.extract_parts(F.col("Body"))).alias("pos", "code"))


@P.add("code_parse_wrap")
def code_parse_wrap(t: Tables) -> DataFrame:
    return snippets(t).select("Id", "pos", C.code_wrap(F.col("code")).alias("wrap"))


@P.add("code_normalize")
def code_normalize(t: Tables) -> DataFrame:
    return snippets(t).select("Id", "pos", C.code_normalize(F.col("code")).alias("code"))


@P.add("code_lex")
def code_lex(t: Tables) -> DataFrame:
    return snippets(t).select("Id", "pos", F.array_join(C.code_lex(F.col("code")), " ").alias("tokens"))


@P.add("code_sequence")
def code_sequence(t: Tables) -> DataFrame:
    return snippets(t).select("Id", "pos", F.array_join(C.code_sequence(F.col("code")), ", ").alias("sequence"))


@P.add("code_tokens")
def code_tokens(t: Tables) -> DataFrame:
    return snippets(t).select("Id", "pos", F.explode(C.code_sequence_tokens(F.col("code"), unique=True)).alias("token"))


@P.add("build_api_list")
def build_api_list(t: Tables) -> DataFrame:
    """API tokens of all answers' code with their counts; error and empty results leave."""
    flags = {"imports": True, "comments": False}
    return snippets(t).select(F.explode(C.code_sequence_tokens(F.col("code"), **flags)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


# token features


def distinct_words(t: Tables) -> DataFrame:
    return each_word(t).select("token").distinct()


# character by character: letters by what their other case is, digits with , and ., and the rest
_KINDS = r"list_distinct(list_transform(string_split(token, ''), lambda c: CASE WHEN c <> lower(c) THEN 'U' WHEN c <> upper(c) THEN 'L' WHEN regexp_matches(c, '[\p{Nd},.]') THEN 'D' ELSE 'S' END))"


def _only(kinds: str) -> str:
    return f"len(list_filter(ks, lambda k: k NOT IN ({', '.join(repr(k) for k in kinds)}))) = 0"


_TYPE = f"""CASE WHEN {_only('U')} THEN 'AllUpper' WHEN {_only('D')} THEN 'AllDigit' WHEN {_only('S')} THEN 'AllSymbol' WHEN {_only('UD')} THEN 'AllUpperDigit'
    WHEN {_only('US')} THEN 'AllUpperSymbol' WHEN {_only('DS')} THEN 'AllDigitSymbol' WHEN {_only('UDS')} THEN 'AllUpperDigitSymbol'
    WHEN left(token, 1) <> lower(left(token, 1)) THEN 'InitUpper' WHEN {_only('UL')} THEN 'AllLetter' WHEN {_only('ULD')} THEN 'AllAlnum' ELSE 'NO' END"""


@P.add("feat_type", f"WITH {_EACH}, x AS (SELECT token, {_KINDS} AS ks FROM d) SELECT token, {_TYPE} AS type FROM x", "q")
def feat_type(t: Tables) -> DataFrame:
    return distinct_words(t).select("token", N.token_type(F.col("token")).alias("type"))


_SHAPE = r"array_to_string(list_transform(string_split(token, ''), lambda c: CASE WHEN c <> lower(c) THEN 'U' WHEN c <> upper(c) THEN 'L' WHEN regexp_matches(c, '\p{Nd}') THEN 'D' WHEN c IN ('.', '_') THEN '.' WHEN c IN ('(', '{', '[', '<') THEN '(' WHEN c IN (')', '}', ']', '>') THEN ')' ELSE '-' END), '')"


@P.add("feat_shape", f"WITH {_EACH} SELECT token, {_SHAPE} AS shape FROM d", "q")
def feat_shape(t: Tables) -> DataFrame:
    return distinct_words(t).select("token", N.token_shape(F.col("token")).alias("shape"))


def _tf(x: str) -> str:
    return f"CASE WHEN {x} THEN 'T' ELSE 'F' END"


_FLAGS = {
    "brac": _tf("ends_with(token, '()')"),
    "dot": _tf("contains(token, '.')"),
    "uscr": _tf("contains(token, '_')"),
    "init_cap": _tf("left(token, 1) <> lower(left(token, 1))"),
    "ccase": _tf(f"regexp_matches(token, '{N.CAMEL}')"),
    "api_ptrn": _tf(f"regexp_matches(token, '{N.API}')"),
}


@P.add("feat_flags", f"WITH {_EACH} SELECT token, " + ", ".join(f"{v} AS {k}" for k, v in _FLAGS.items()) + " FROM d", "q")
def feat_flags(t: Tables) -> DataFrame:
    return distinct_words(t).select("token", *(v.alias(k) for k, v in N.token_flags(F.col("token")).items()))


@P.add("feat_affix", f"WITH {_EACH} SELECT token, " + ", ".join(f"left(token, {k}) AS p{k}, right(token, {k}) AS s{k}" for k in range(1, 5)) + " FROM d", "q")
def feat_affix(t: Tables) -> DataFrame:
    return distinct_words(t).select("token", *(v.alias(k) for k, v in N.token_affixes(F.col("token")).items()))


_KEY = r"lower(regexp_replace(token, '\(\)$', ''))"
# name lists are read from the table of tags, in six parts; Brown paths and clusters follow a rule from counts of tokens
_NAMES = "g AS (SELECT lower(TagName) AS name, Id % 6 AS list FROM tags WHERE TagName IS NOT NULL)"
_IN_LIST = {k: _tf(f"EXISTS (SELECT 1 FROM g WHERE list = {i} AND name = {_KEY})") for i, k in enumerate(N.LISTS)}
_COUNTED = "f AS (SELECT token, count(*) AS n FROM k GROUP BY token)"
_PATH = "CASE WHEN n >= 2 THEN bin(n * 37 + length(token)) ELSE '' END"
_CLUSTER = {k: f"CASE WHEN n >= 3 THEN ((n * 7 + length(token)) % {k[2:]})::VARCHAR ELSE '' END" for k in N.CLUSTERS}


def _written(df: DataFrame) -> str:
    """A text file of the rows' columns, tab-separated, in the shared folder."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/lists-{uuid.uuid4().hex}"
    df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in df.columns)).alias("value")).write.text(path)
    return path


def name_lists(t: Tables) -> DataFrame:
    """(name, lists) of the six lists of names, each a text file of its own."""
    tags, parts = t.raw("tags").where("TagName is not null"), []
    for i, k in enumerate(N.LISTS):
        names = R.gazetteer(t.spark, _written(tags.where(F.col("Id") % 6 == i).select("TagName")))
        parts.append(names.select("name", F.lit(k).alias("list")))
    return reduce(DataFrame.unionByName, parts).groupBy("name").agg(F.collect_set("list").alias("lists"))


def counted(each: DataFrame) -> DataFrame:
    return each.groupBy("token").agg(F.count("*").alias("n"))


def paths_of(often: DataFrame) -> DataFrame:
    """(token, path) from a file of Brown paths over the tokens of two occurrences or more."""
    rows = often.where("n >= 2").select(F.bin(F.col("n") * 37 + F.length("token")).alias("path"), "token", "n")
    return R.brown_paths(often.sparkSession, _written(rows)).select("token", "path")


def clusters_of(often: DataFrame) -> DataFrame:
    """(token, cluster ids) of the tokens of three occurrences or more."""
    return often.where("n >= 3").select("token", *(((F.col("n") * 7 + F.length("token")) % int(k[2:])).cast("string").alias(k) for k in N.CLUSTERS))


_GAZ = f"WITH {_EACH}, {_NAMES} SELECT token, " + ", ".join(f"{v} AS {k}" for k, v in _IN_LIST.items()) + " FROM d"


@P.add("feat_gazetteer", _GAZ, "q")
def feat_gazetteer(t: Tables) -> DataFrame:
    """Flags from six name lists read from files; a list is configuration, so it is the broadcast side."""
    joined = distinct_words(t).withColumn("key", N.gazetteer_key(F.col("token"))).join(F.broadcast(name_lists(t)), F.col("key") == F.col("name"), "left")
    return joined.select("token", *(N.flag(F.coalesce(F.array_contains("lists", k), F.lit(False))).alias(k) for k in N.LISTS))


@P.add("feat_brown", f"WITH {_EACH}, {_COUNTED}, b AS (SELECT token, {_PATH} AS path FROM f) SELECT token, path AS brown, " + ", ".join(f"left(path, {n}) AS brown_p{n}" for n in N.PREFIXES) + " FROM b", "q")
def feat_brown(t: Tables) -> DataFrame:
    often = cut(counted(each_word(t)))
    path = F.coalesce("path", F.lit(""))
    return often.select("token").join(paths_of(often), "token", "left").select("token", path.alias("brown"), *(F.substring(path, 1, n).alias(f"brown_p{n}") for n in N.PREFIXES))


@P.add("token_ce", f"WITH {_EACH}, {_COUNTED} SELECT token, " + ", ".join(f"{v} AS {k}" for k, v in _CLUSTER.items()) + " FROM f WHERE n >= 3", "q")
def token_ce(t: Tables) -> DataFrame:
    """The table of cluster ids: tokens seen at least 3 times."""
    return clusters_of(counted(each_word(t)))


@P.add("feat_ce", f"WITH {_EACH}, {_COUNTED} SELECT Id, pos, token, " + ", ".join(f"{v} AS {k}" for k, v in _CLUSTER.items()) + " FROM k JOIN f USING (token)", "q")
def feat_ce(t: Tables) -> DataFrame:
    """Cluster ids of every token of a sentence, empty for tokens the table does not know."""
    each = each_word(t)
    joined = each.join(clusters_of(counted(each)), "token", "left")
    return joined.select("Id", F.col("pos").cast("long").alias("pos"), "token", *(F.coalesce(k, F.lit("")).alias(k) for k in N.CLUSTERS))


_FIELDS = (
    {"w": "token", "wl": "lower(token)"} | _FLAGS | {f"p{k}": f"left(token, {k})" for k in range(1, 5)} | {f"s{k}": f"right(token, {k})" for k in range(1, 5)} | _IN_LIST
    | {"brown": _PATH} | {f"brown-p{n}": f"left({_PATH}, {n})" for n in N.PREFIXES} | _CLUSTER
)
_WITH_FIELDS = f"{_EACH}, {_NAMES}, {_COUNTED}, y AS (SELECT token, " + ", ".join(f'{v} AS "{k}"' for k, v in _FIELDS.items()) + " FROM f), z AS (SELECT Id, pos, y.* FROM k JOIN y USING (token))"


@P.add("broadcast_lookup_features", f"WITH {_WITH_FIELDS} SELECT Id, pos, token, concat_ws('|', " + ", ".join(f'"{k}"' for k in (*N.LISTS, "brown", *N.CLUSTERS)) + ") AS found FROM z", "q")
def broadcast_lookup_features(t: Tables) -> DataFrame:
    """What the lookups say of every token of a sentence: lists, path and clusters, by joins."""
    rows = with_fields(t, words(t).select(F.struct("Id").alias("key"), "ws"))
    each = rows.select("key.Id", F.posexplode("x").alias("pos", "f"))
    return each.select("Id", F.col("pos").cast("long").alias("pos"), F.col("f.w").alias("token"), F.concat_ws("|", *(F.col("f")[k] for k in (*N.LISTS, "brown", *N.CLUSTERS))).alias("found"))


def known_fields(t: Tables, often: DataFrame) -> tuple[DataFrame, dict]:
    """A row for each token of (token, n) with what the lists, the paths and the clusters say, and the fields of it."""
    known = often.select("token", N.gazetteer_key(F.col("token")).alias("name")).join(F.broadcast(name_lists(t)), "name", "left")
    known = known.join(paths_of(often), "token", "left").join(clusters_of(often), "token", "left")
    return known, N.token_fields(F.col("token"), F.col("lists"), F.col("path"), {k: F.col(k) for k in N.CLUSTERS})


def with_fields(t: Tables, sentences: DataFrame) -> DataFrame:
    """(key, ws, x): sentences (key, ws) with every field of every token, x in the order of ws. The features of a token
    are made once for each distinct token, by joins with the lists, the paths and the clusters."""
    each = sentences.select("key", F.posexplode("ws").alias("pos", "token"))
    known, fields = known_fields(t, cut(counted(each)))
    made = known.select("token", F.struct(*(v.alias(k) for k, v in fields.items())).alias("f"))
    placed = each.join(made, "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "f"))).alias("x"))
    return placed.select("key", F.transform("x", lambda v: v["f"]["w"]).alias("ws"), F.transform("x", lambda v: v["f"]).alias("x"))


@P.add("bos_eos", f"WITH {_EACH} SELECT Id, pos, token, CASE WHEN pos = 0 THEN 'T' ELSE 'F' END AS bos, CASE WHEN lead(pos) OVER (PARTITION BY Id ORDER BY pos) IS NULL THEN 'T' ELSE 'F' END AS eos FROM k", "q")
def bos_eos(t: Tables) -> DataFrame:
    each = words(t).select("Id", F.size("ws").alias("n"), F.posexplode("ws").alias("pos", "token"))
    return each.select("Id", F.col("pos").cast("long").alias("pos"), "token", N.flag(F.col("pos") == 0).alias("bos"), N.flag(F.col("pos") == F.col("n") - 1).alias("eos"))


_CONTEXT = f"WITH {_EACH}, c AS (SELECT Id, pos, token, lag(token) OVER x AS p, lead(token) OVER x AS n FROM k WINDOW x AS (PARTITION BY Id ORDER BY pos)) SELECT Id, pos, concat_ws(chr(9), 'w[-1]=' || p, 'w[0]=' || token, 'w[1]=' || n, 'w[-1]|w[0]=' || p || '|' || token, CASE WHEN p IS NULL THEN '__BOS__' END, CASE WHEN n IS NULL THEN '__EOS__' END) AS features FROM c"


@P.add("lead_lag_template", _CONTEXT, "q")
def lead_lag_template(t: Tables) -> DataFrame:
    """Context features of each token, read off the sentence's array; the order of templates is kept."""
    order = N.read_templates("w -1 0 1 -1,0")
    rows = words(t).select("Id", F.transform("ws", lambda w: F.struct(w.alias("w"))).alias("x"))
    rows = rows.select("Id", F.posexplode(N.context_template(order, F.col("x"))).alias("pos", "f"))
    return rows.select("Id", F.col("pos").cast("long").alias("pos"), F.array_join("f", "\t").alias("features"))


def _at(field: str, offset: int) -> str:
    return f'"{field}"' if offset == 0 else f'{"lag" if offset < 0 else "lead"}("{field}") OVER x'


_ALL = ", ".join("'{}=' || {}".format("|".join(f"{f}[{o}]" for f, o in tpl), " || '|' || ".join(_at(f, o) for f, o in tpl)) for tpl in N.read_templates())


@P.add("feat_template", f"WITH {_WITH_FIELDS} SELECT Id, pos, md5(concat_ws(chr(9), {_ALL}, CASE WHEN lag(pos) OVER x IS NULL THEN '__BOS__' END, CASE WHEN lead(pos) OVER x IS NULL THEN '__EOS__' END)) AS features FROM z WINDOW x AS (PARTITION BY Id ORDER BY pos)", "q")
def feat_template(t: Tables) -> DataFrame:
    """The digest of each token's features from every template."""
    rows = with_fields(t, words(t).select(F.struct("Id").alias("key"), "ws"))
    each = rows.select("key.Id", F.posexplode(N.context_template(N.read_templates(), F.col("x"))).alias("pos", "f"))
    return each.select("Id", F.col("pos").cast("long").alias("pos"), F.md5(F.array_join("f", "\t")).alias("features"))


@P.add("sentence_id", f"WITH {_EACH} SELECT Id, pos, sum(CASE WHEN right(token, 1) = '?' THEN 1 ELSE 0 END) OVER (PARTITION BY Id ORDER BY pos)::BIGINT AS sent FROM k", "q")
def sentence_id(t: Tables) -> DataFrame:
    w = Window.partitionBy("Id").orderBy("pos")
    return each_word(t).select("Id", F.col("pos").cast("long").alias("pos"), F.sum(F.when(F.right("token", F.lit(1)) == "?", 1).otherwise(0)).over(w).alias("sent"))


@P.add("crf_sequence", f"WITH {_EACH} SELECT Id, pos, token, 'O' AS entity FROM k", "q")
def crf_sequence(t: Tables) -> DataFrame:
    items = F.transform("ws", lambda w: F.struct(w.alias("token"), F.lit("O").alias("entity")))
    return words(t).select("Id", F.posexplode(items).alias("pos", "x")).select("Id", F.col("pos").cast("long").alias("pos"), "x.token", "x.entity")


_CLASS, _CALL = r"^[A-Z][a-z]+[A-Z]\w*", r"\(\)"


def rule_labels(ws):
    """A rule tagger: class-like names begin an entity or go on with one, API calls are entities of their own."""
    def label(w, i):
        before = F.get(ws, i - 1)
        cap = w.rlike(_CLASS)
        more = (i > 0) & before.rlike(_CLASS)
        return F.struct(w.alias("token"), F.when(cap & more, "I-Class").when(cap, "B-Class").when(w.rlike(_CALL), "B-Api").otherwise("O").alias("label"))

    return F.transform(ws, label)


_LABEL = f"WITH {_EACH}, c AS (SELECT Id, pos, token, regexp_matches(token, '^[A-Z][a-z]+[A-Z]\\w*') AS cap, coalesce(lag(regexp_matches(token, '^[A-Z][a-z]+[A-Z]\\w*')) OVER (PARTITION BY Id ORDER BY pos), false) AS more FROM k), y AS (SELECT Id, pos, token, CASE WHEN cap AND more THEN 'I-Class' WHEN cap THEN 'B-Class' WHEN regexp_matches(token, '\\(\\)') THEN 'B-Api' ELSE 'O' END AS label FROM c)"


@P.add("entity_merge", _LABEL + ", s AS (SELECT *, sum(CASE WHEN label LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY Id ORDER BY pos) AS ent FROM y WHERE label <> 'O'), z AS (SELECT Id, ent, string_agg(token, ' ' ORDER BY pos) AS txt, min_by(label, pos) AS label FROM s GROUP BY Id, ent) SELECT Id, string_agg(label[3:] || '##' || txt, '<_ent_>' ORDER BY ent) AS entities FROM z GROUP BY Id", "q")
def entity_merge(t: Tables) -> DataFrame:
    merged = words(t).select("Id", N.merge_entities(rule_labels(F.col("ws"))).alias("e"))
    return merged.where(F.size("e") > 0).select("Id", F.array_join("e", "<_ent_>").alias("entities"))


@P.add("carry_prev_entity", _LABEL + ", s AS (SELECT Id, pos, token, label, CASE WHEN label <> 'O' THEN label[3:] END AS kind FROM y) SELECT Id, pos, token, label, coalesce(last_value(kind IGNORE NULLS) OVER (PARTITION BY Id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prev FROM s", "q")
def carry_prev_entity(t: Tables) -> DataFrame:
    """Every token with the entity type in force before it, which outlives an O."""
    each = words(t).select("Id", F.posexplode(rule_labels(F.col("ws"))).alias("pos", "x")).select("Id", F.col("pos").cast("long").alias("pos"), "x.token", "x.label")
    before = Window.partitionBy("Id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.when(F.col("label") != "O", F.substring("label", 3, 1000))
    return each.withColumn("kind", kind).select("Id", "pos", "token", "label", F.coalesce(F.last("kind", ignorenulls=True).over(before), F.lit("")).alias("prev"))


def all_sentences(t: Tables) -> DataFrame:
    """(key, ws): titles and the sentences of bodies and answers, words by white space. key: Id, part, sent; the part of
    an answer is its id."""
    parts = [words(t).select(F.struct("Id", F.lit(0).cast("long").alias("part"), F.lit(0).alias("sent")).alias("key"), "ws")]
    for rows, part in ((body(t), F.lit(1).cast("long")), (t.a("ParentId", "Body").where("ParentId is not null and Body is not null").select(F.col("ParentId").alias("Id"), "Body", F.col("Id").alias("part")), F.col("part"))):
        text = T.sentences(H.html_text(F.col("Body")))
        each = rows.select("Id", part.alias("part"), F.posexplode(text).alias("sent", "text"))
        parts.append(each.select(F.struct("Id", "part", "sent").alias("key"), F.split(F.trim("text"), r"\s+").alias("ws")).where("ws[0] <> ''"))
    return reduce(DataFrame.unionByName, parts)


def sharded(t: Tables) -> tuple[DataFrame, DataFrame, int]:
    """All sentences (shard, o, key, text), tokens parted by blanks, the fields of the distinct tokens of every shard, and the number of shards.
    Texts are parsed once; a token's fields are made once and go to the shards that hold it."""
    rows = kept(all_sentences(t), "sentences")
    number = max(1, -(-rows.count() // L.SHARD))
    shard = F.pmod(F.xxhash64("key"), F.lit(number)).cast("int").alias("shard")
    placed = rows.select(shard, F.xxhash64("key").alias("o"), "key", F.array_join("ws", " ").alias("text"))
    mine = kept(rows.select(shard, "ws").select("shard", F.explode(F.array_distinct("ws")).alias("token")).distinct(), "held")
    often = kept(counted(rows.select(F.explode("ws").alias("token"))), "counts")
    fields = known_fields(t, often)
    kind = F.when(F.col("token").rlike(_CLASS), "C").when(F.col("token").rlike(_CALL), "A").otherwise("O")
    made = kept(fields[0].select(*L.packed_fields(fields[1], kind)), "fields")
    return placed, kept(mine.join(made, "token"), "tokens"), number


def trained(placed: DataFrame, tokens: DataFrame, number: int) -> DataFrame:
    """The tagger fitted on every sentence with the rule tagger's labels."""
    return kept(L.train(placed, tokens, number), "tagger")


def tagged(t: Tables) -> DataFrame:
    """(key, tagged): every sentence tagged by the trained model, all shards at once."""
    placed, tokens, number = sharded(t)
    return L.tag(placed, tokens, trained(placed, tokens, number))


@P.add("crf_train")
def crf_train(t: Tables) -> DataFrame:
    return L.weights_of(trained(*sharded(t)))


@P.add("crf_tag")
def crf_tag(t: Tables) -> DataFrame:
    return tagged(t).select("key.*", F.posexplode("tagged").alias("pos", "x")).select("Id", "part", "sent", "pos", "x.token", "x.label")


@P.add("entity_extract_parallel")
def entity_extract_parallel(t: Tables) -> DataFrame:
    """Distinct entities of every question, its title, body and answers, by the trained tagger. Tokens labelled O say
    nothing and leave first."""
    found = tagged(t).select("key.Id", F.filter("tagged", lambda x: x["label"] != "O").alias("tagged")).where(F.size("tagged") > 0)
    each = found.select("Id", F.explode(N.merge_entities(F.col("tagged"))).alias("entity"))
    return each.groupBy("Id").agg(F.array_join(F.array_sort(F.collect_set("entity")), "<_ent_>").alias("entities"))


QUERIES, SQL = P.QUERIES, P.SQL
