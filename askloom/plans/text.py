"""Queries of text cleaning and of the string-list codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.functions import text as X
from askloom.plans.base import Part, Tables

P = Part()
_NOISE = {
    1: " at com.acme.io.Reader.load(Reader.java:12) at sun.misc.Unsafe.park(Native Method)  end",
    2: "id 0101.1100.0011.1111 and 10.0.0.1",
    3: "see org.apache.commons.lang.text.builder.Formatter now",
    4: "x" * 45 + " C# c++ C++ #tag a+b back\\slash",
    5: "---- **** ====== __ -- C:\\Users\\me\\file.txt \\srv\\x",
    6: ":) :-( =D plain `tick` 12:34:56",
    7: "nice ^_^ one",
    8: "8-) fine and 8D",
    9: "sad :o[ and =(",
    10: ";-) is a wink, :p is none",
    11: "\\item \\n \\textbf{a} x\\ab\\cd C:\\ab\\cd\\ef, \\\\--\\\\-- c:\\a\\bc",
    12: "#!_~+=:; ~~~ 0a1b" + "01" * 30 + " __init__ a::b",
}
_DOUBLED = {k: v.replace("'", "''") for k, v in _NOISE.items()}
_NOISE_SQL = " UNION ALL ".join(f"SELECT {-k}::BIGINT, '{v}'" for k, v in _DOUBLED.items())
_BODIES = f"WITH b AS (SELECT Id AS id, Body AS body FROM q WHERE Body IS NOT NULL UNION ALL {_NOISE_SQL}) "


def _bodies(t: Tables) -> DataFrame:
    """Question bodies and a few noise lines which hold what bodies rarely hold."""
    noise = t.spark.createDataFrame([(-k, v) for k, v in _NOISE.items()], "id long, body string")
    return t.q("Body").where("Body is not null").select(F.col("Id").alias("id"), F.col("Body").alias("body")).unionByName(noise)


def _rx(expr: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        expr = "regexp_replace({}, '{}', '{}', 'g')".format(expr, pattern.replace("'", "''"), to)
    return expr


_SQUEEZE = (" {2,}", " ")
_FRAMES = [(X.STACK_FRAME, " "), _SQUEEZE]
_PACKAGES = [(X.PACKAGE, " "), _SQUEEZE]
_NORMAL = [(X.LONG_RUN, " "), (X.PUNCT_RUN, " "), (X.PUNCT_LISTED, " "), (r"([Cc]#)|#", r"\1"), (r"([Cc]\+\+)|\+", r"\1"), _SQUEEZE]
_SPACE = (r"[ \t\n\r\f\x0B]+", " ")
_HAPPY, _SAD = r"regexp_matches(body, '(\^_\^|[:=8](|o|O|-)[D\)\]])')", r"regexp_matches(body, '[:=8](|o|O|-)[\(\[]')"
_CLEANERS = {
    "strip_separators": (X.strip_separators, _rx("body", (X.SEPARATORS, " "))),
    "strip_whitespace": (X.strip_whitespace, f"trim({_rx('body', _SPACE)})"),
    "remove_stack_traces": (X.remove_stack_traces, _rx("body", *_FRAMES)),
    "remove_binary_strings": (X.remove_binary_strings, _rx("body", (X.BINARY, " "))),
    "remove_long_packages": (X.remove_long_packages, _rx("body", *_PACKAGES)),
    "filter_line": (X.filter_line, _rx("body", (X.BINARY, ""), (X.PACKAGE, ""), (r"[^ \t\n\r\f\x0B]{30,}", ""))),
    "normalize_text": (X.normalize_text, _rx("body", *_NORMAL)),
    "remove_paths": (X.remove_paths, _rx("body", (r"\b((?:[Cc]:)?(?:\\\S{2,}){2,})\b", " "))),
    "remove_large_tokens": (X.remove_large_tokens, _rx("body", (r"[a-b0-9]{50,}|[\*-=\+~#!_]{3,}", ""))),
    "process_corpus": (X.clean_corpus, _rx("body", *_FRAMES, (X.BINARY, " "), *_PACKAGES, *_NORMAL)),
    "emoticon_polarity": (
        X.emoticon_polarity,
        f"CASE WHEN {_HAPPY} AND {_SAD} THEN 'BOTH_HS' WHEN {_HAPPY} THEN 'HAPPY' WHEN {_SAD} THEN 'SAD' ELSE 'NA' END",
    ),
}
for _name, (_f, _sql) in _CLEANERS.items():
    P.add(_name, f"{_BODIES} SELECT id, {_sql} AS body FROM b", "q")(lambda t, f=_f: _bodies(t).select("id", f(F.col("body")).alias("body")))

_MARKS = "".join("\\" + x for x in X.PUNCTUATION).replace("'", "''")
_WORDS = "len(list_filter(string_split_regex(body, '[ {}]'), lambda x: x <> ''))".format(_MARKS.replace("\\|", ""))
_QUALITY = f"{_WORDS} / greatest(length(body) - length(regexp_replace(body, '[{_MARKS}]', '', 'g')), 1)"


@P.add("text_line_quality", f"{_BODIES} SELECT id, round({_QUALITY}, 6) AS quality FROM b", "q")
def text_line_quality(t: Tables) -> DataFrame:
    return _bodies(t).select("id", F.round(X.line_quality(F.col("body")), 6).alias("quality"))


@P.add("filter_text_quality", f"{_BODIES} SELECT id FROM b WHERE length(body) <= 1000 OR {_QUALITY} >= 1.6", "q")
def filter_text_quality(t: Tables) -> DataFrame:
    return _bodies(t).where(X.keeps_quality(F.col("body"))).select("id")


_EVAL = _rx(_rx("body", (X.SEPARATORS, " ")), _SPACE)


@P.add("eval_text", f"{_BODIES}, f AS (SELECT id, trim({_EVAL}) AS body FROM b) SELECT id, body FROM f WHERE length(body) <= 1000 OR {_QUALITY} >= 1.6", "q")
def eval_text(t: Tables) -> DataFrame:
    """Formatted text of the posts which pass the quality gate; the others are rejected."""
    formed = _bodies(t).select("id", X.strip_whitespace(X.strip_separators(F.col("body"))).alias("body"))
    return formed.where(X.keeps_quality(F.col("body")))


@P.add("eval_text_of_posts")
def eval_text_of_posts(t: Tables) -> DataFrame:
    """eval_text of whole posts, in which code blocks are their API tokens."""
    from askloom.functions.html import replace_pre

    formed = t.q("Body").where("Body is not null").select(F.col("Id").alias("id"), X.strip_whitespace(X.strip_separators(replace_pre(F.col("Body")))).alias("body"))
    return formed.where(X.keeps_quality(F.col("body")))


@P.add("process_corpus_norm")
def process_corpus_norm(t: Tables) -> DataFrame:
    """The corpus chain with its token step: frames, binary strings and packages go, tokens are normalised, then the text."""
    from askloom.functions.tokens import norm_text

    filtered = X.remove_long_packages(X.remove_binary_strings(X.remove_stack_traces(F.col("body"))))
    return _bodies(t).select("id", X.normalize_text(norm_text(filtered)).alias("body"))


@P.add("backtick_strip", "SELECT Id AS id, translate(Text, '`', ' ') AS body FROM c WHERE Text IS NOT NULL", "c")
def backtick_strip(t: Tables) -> DataFrame:
    return t.c("Text").where("Text is not null").select(F.col("Id").alias("id"), X.backtick_strip(F.col("Text")).alias("body"))


_ANGLED = "SELECT Id, Tags FROM q WHERE regexp_full_match(Tags, '(<[a-z0-9.#+-]+>)+')"


@P.add(
    "split_tags",
    f"WITH g AS ({_ANGLED}), s AS (SELECT Id, list_filter(string_split(regexp_replace(Tags, '^<|>$', '', 'g'), '><'), lambda x: x <> '' AND x <> 'java') AS t FROM g) SELECT Id AS id, CASE WHEN len(t) = 0 THEN '<unk>' ELSE array_to_string(t, ' ') END AS tags FROM s",
    "q",
)
def split_tags(t: Tables) -> DataFrame:
    angled = t.q("Tags").where(F.col("Tags").rlike(r"^(<[a-z0-9.#+-]+>)+\z"))
    return angled.select(F.col("Id").alias("id"), F.array_join(X.split_tags(F.col("Tags")), " ").alias("tags"))


@P.add("split_entities", "SELECT Id AS id, CASE WHEN Entities IS NULL OR Entities = '' THEN '<unk>' ELSE replace(Entities, '<_ent_>', ' ') END AS entities FROM q", "q")
def split_entities(t: Tables) -> DataFrame:
    return t.q("Entities").select(F.col("Id").alias("id"), X.split_entities(F.col("Entities")).alias("entities"))


@P.add("split_snippets", "SELECT Id AS id, CASE WHEN Snippets IS NULL OR Snippets = '' THEN 0 ELSE len(string_split(Snippets, '<_post_>')) END::INT AS blocks FROM q", "q")
def split_snippets(t: Tables) -> DataFrame:
    return t.q("Snippets").select(F.col("Id").alias("id"), F.size(X.split_snippets(F.col("Snippets"))).alias("blocks"))


@P.add(
    "clean_entity",
    r"""WITH x AS (SELECT Id, unnest(string_split(Entities, '<_ent_>')) AS ent FROM q WHERE Entities <> '')
    SELECT Id AS id, regexp_replace(regexp_replace(lower(regexp_replace('Tool##' || ent, '^[A-Za-z]+##', '')), '[(\[{][^ ]*', '', 'g'), '''s', '', 'g') AS entity FROM x""",
    "q",
)
def clean_entity(t: Tables) -> DataFrame:
    ents = t.q("Entities").where("Entities <> ''").select("Id", F.explode(F.split("Entities", "<_ent_>")).alias("ent"))
    return ents.select(F.col("Id").alias("id"), X.clean_entity(F.concat(F.lit("Tool##"), "ent")).alias("entity"))


_FIRST = "WITH f AS (SELECT Id, string_split(Snippets, '<_post_>')[1] AS b FROM q WHERE Snippets <> '')"


@P.add(
    "parse_snippet",
    _FIRST + r""" SELECT Id AS id, regexp_extract(b, 'Post: ([^\n]*)', 1) AS anslink, TRY_CAST(regexp_extract(b, '##Score (-?\d{1,5})', 1) AS INT) AS score,
    replace(regexp_replace(b, 'Post: [^\n]*\n|##Score [^\n]*\n', '', 'g'), '<_code_>', chr(10) || chr(10)) AS snippet FROM f""",
    "q",
)
def parse_snippet(t: Tables) -> DataFrame:
    first = t.q("Snippets").where("Snippets <> ''").select("Id", F.split("Snippets", "<_post_>")[0].alias("b"))
    return first.select(F.col("Id").alias("id"), X.parse_snippet(F.col("b")).alias("s")).select("id", "s.*")


@P.add("build_link", "SELECT Id AS id, 'https://qa.example/questions/' || Id AS link FROM q", "q")
def build_link(t: Tables) -> DataFrame:
    return t.q().select(F.col("Id").alias("id"), F.concat(F.lit("https://qa.example/questions/"), "Id").alias("link"))


@P.add("round_sim", "SELECT Id AS id, round(Score / 7.0, 4) AS sim FROM a WHERE Score IS NOT NULL", "a")
def round_sim(t: Tables) -> DataFrame:
    return t.a("Score").where("Score is not null").select(F.col("Id").alias("id"), F.round(F.col("Score") / F.lit(7.0), 4).alias("sim"))


_CODES = ["_IM_java.util.List", "_VAR_String", "_OC_File", "_MC_List.add", "_UMC_run", "_COM_note", "plain", "__ERROR__", "__EMPTY__"]
_CODES_SQL = "WITH k AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in _CODES) + ") v(code))"


@P.add("strip_token_prefix", _CODES_SQL + " SELECT code, regexp_replace(code, '^_(?:IM|VAR|OC|MC|UMC|COM)_', '') AS token FROM k")
def strip_token_prefix(t: Tables) -> DataFrame:
    codes = t.spark.createDataFrame([(c,) for c in _CODES], "code string")
    return codes.select("code", X.strip_token_prefix(F.col("code")).alias("token"))


@P.add("case_code_error", _CODES_SQL + " SELECT code FROM k WHERE code NOT IN ('__ERROR__', '__EMPTY__')")
def case_code_error(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(c,) for c in _CODES], "code string").where(~F.col("code").isin("__ERROR__", "__EMPTY__"))


@P.add("distinct_ordered", "SELECT Id AS id, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: list_position(w, z[1]) = z[2]), lambda z: z[1]), ' ') AS words FROM (SELECT Id, string_split(Title, ' ') AS w FROM q WHERE Title IS NOT NULL)", "q")
def distinct_ordered(t: Tables) -> DataFrame:
    return t.q("Title").where("Title is not null").select(F.col("Id").alias("id"), F.array_join(F.array_distinct(F.split("Title", " ")), " ").alias("words"))


QUERIES, SQL = P.QUERIES, P.SQL
