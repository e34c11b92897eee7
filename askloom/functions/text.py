"""Text cleaning as Column -> Column functions; all run inside the JVM, null in gives null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define the cleaning rules.
IDENT = r"[a-zA-Z_$][a-zA-Z0-9_$]*"
STACK_FRAME = rf" at ({IDENT}\.)+{IDENT}\((?:[a-zA-Z_$][a-zA-Z0-9_$]{{1,30}}\.java:[0-9]{{1,4}}|[a-zA-Z]{{1,30}} [a-zA-Z]{{1,30}})\)"
BINARY = r"([01]{4,20}\.){3,30}[01]{4,20}"
PACKAGE = r"([a-zA-Z0-9_$]{2,50}\.){5,}[a-zA-Z0-9_$]{2,50}"
LONG_RUN = r"[^ \\.]{40,}"
PUNCT_RUN = r"[!-/:-@\[-`{-~]{4,}"
PUNCT_LISTED = r"""[!"%&$^*@`~(),?=/\\|<:;>{}\-\[\]]"""
SEPARATORS = r"[-=+*#_]{4,}"
# two segments of two characters or more; a longer path is a second segment that holds backslashes
WINDOWS_PATH = r"\b(?:[Cc]:)?\\\S{2,}\\\S{2,}\b"
LARGE_TOKEN = r"[a-b0-9]{50,}|[*-=+~#!_]{3,}"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
HAPPY, SAD = r"\^_\^|[:=8][oO-]?[)\]D]", r"[:=8][oO-]?[(\[]"


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, " {2,}", " ")


def strip_separators(c: Column) -> Column:
    return F.regexp_replace(c, SEPARATORS, " ")


def strip_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " "))


def word_count(c: Column) -> Column:
    """Runs between blanks and punctuation other than the vertical bar."""
    marks = "".join("\\" + x for x in PUNCTUATION if x != "|")
    return F.size(F.filter(F.split(c, f"[ {marks}]"), lambda x: x != ""))


def punctuation_count(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, PUNCTUATION, ""))


def line_quality(c: Column) -> Column:
    """Words per punctuation character; without punctuation the number of words."""
    return word_count(c) / F.greatest(punctuation_count(c), F.lit(1))


def keeps_quality(c: Column, length: int = 1000, least: float = 1.6) -> Column:
    """Texts up to `length` always pass, longer ones need `least` words a punctuation character."""
    return (F.length(c) <= length) | (line_quality(c) >= least)


def remove_stack_traces(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, STACK_FRAME, " "))


def remove_binary_strings(c: Column) -> Column:
    return F.regexp_replace(c, BINARY, " ")


def remove_long_packages(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, PACKAGE, " "))


def filter_line(c: Column) -> Column:
    """The entity path's variant: removed, not blanked, and anything of 30 characters goes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, BINARY, ""), PACKAGE, ""), r"[^ \t\n\r\f\x0B]{30,}", "")


def normalize_text(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, LONG_RUN, " "), PUNCT_RUN, " ")
    c = F.regexp_replace(c, PUNCT_LISTED, " ")
    c = F.regexp_replace(F.regexp_replace(c, r"([Cc]#)|#", "$1"), r"([Cc]\+\+)|\+", "$1")
    return squeeze(c)


def remove_paths(c: Column) -> Column:
    return F.regexp_replace(c, WINDOWS_PATH, " ")


def remove_large_tokens(c: Column) -> Column:
    return F.regexp_replace(c, LARGE_TOKEN, "")


def backtick_strip(c: Column) -> Column:
    return F.translate(c, "`", " ")


def clean_corpus(c: Column) -> Column:
    """The whole chain of the corpus: frames, binary strings, packages, then normalisation."""
    return normalize_text(remove_long_packages(remove_binary_strings(remove_stack_traces(c))))


def emoticon_polarity(c: Column) -> Column:
    happy, sad = c.rlike(HAPPY), c.rlike(SAD)
    return F.when(happy & sad, "BOTH_HS").when(happy, "HAPPY").when(sad, "SAD").otherwise("NA")


def clean_entity(c: Column) -> Column:
    """Type prefix off, lower case, cut from the first bracket, possessive off."""
    c = F.lower(F.regexp_replace(c, r"^[A-Za-z]+##", ""))
    return F.regexp_replace(F.regexp_replace(c, r"[(\[{][^ ]*", ""), "'s", "")


def split_tags(c: Column, drop: str = "java", empty: str = "<unk>") -> Column:
    """`<a><b>` as an array without `drop`; an empty list gives [empty]."""
    inner = F.regexp_replace(c, r"^<|>$", "")
    tags = F.filter(F.split(inner, "><"), lambda t: (t != "") & (t != drop))
    return F.when(F.size(tags) == 0, F.array(F.lit(empty))).otherwise(tags)


def split_entities(c: Column, empty: str = "<unk>") -> Column:
    """The `<_ent_>` list as one text."""
    return F.when((c == "") | c.isNull(), F.lit(empty)).otherwise(F.replace(c, F.lit("<_ent_>"), F.lit(" ")))


def split_snippets(c: Column) -> Column:
    return F.when((c == "") | c.isNull(), F.array().cast("array<string>")).otherwise(F.split(c, "<_post_>"))


def snippet_block(answer_id: Column, score: Column, snippets: Column, base: str) -> Column:
    """Two header lines and the snippets of one answer."""
    head = F.concat(F.lit(f"Post: {base}"), answer_id.cast("string"), F.lit("\n##Score "), score.cast("string"), F.lit("\n"))
    return F.concat(head, F.array_join(snippets, "<_code_>"))


def parse_snippet(block: Column) -> Column:
    """The first block back as (anslink, score, snippet)."""
    return F.struct(
        F.regexp_extract(block, r"Post: ([^\n]*)", 1).alias("anslink"),
        F.try_to_number(F.regexp_extract(block, r"##Score (-?\d{1,5})", 1), F.lit("S99999")).cast("int").alias("score"),
        F.replace(F.regexp_replace(block, r"Post: [^\n]*\n|##Score [^\n]*\n", ""), F.lit("<_code_>"), F.lit("\n\n")).alias("snippet"),
    )


def strip_token_prefix(c: Column) -> Column:
    return F.regexp_replace(c, r"^_(?:IM|VAR|OC|MC|UMC|COM)_", "")
