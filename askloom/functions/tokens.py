"""Tokenisers for posts: regular-expression column functions where that is enough, Arrow batches where it is not."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_JAVA_ID = r"[A-Za-z_$][A-Za-z0-9_$]*"
#: Protected as one token, in this order: URLs, mails, API calls and dotted names, C#, C++, .NET, hashtags and
#: mentions, percentages, ordinals and versions, words with inner hyphens never.
_PROTECT = re.compile(
    rf"(?:https?|ftp)://\S+"
    rf"|[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
    rf"|(?:{_JAVA_ID}\.)+{_JAVA_ID}(?:\(\))?"
    rf"|{_JAVA_ID}\(\)"
    r"|[Cc]\+\+|[Cc]\#|\.(?:[Nn][Ee][Tt])\b"
    r"|[#@][A-Za-z0-9_]+"
    r"|\d+(?:\.\d+)?%|v\d+(?:\.\d+)+"
    r"|\w+(?:['’](?:s|m|re|ve|ll|d|t))?\#?"
    r"|[^\w\s]"
)
#: Contractions by their ends; the possessive is read as "is".
_ENDINGS = {"n't": "not", "'s": "is", "'m": "am", "'re": "are", "'ve": "have", "'ll": "will", "'d": "would"}
_STEMS = {"ca": "can", "wo": "will", "sha": "shall"}
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")


def code_tokens(text: str | None) -> list[str]:
    """Tokens with API calls, dotted names, URLs, hashtags, C#, C++ and .NET kept whole; contractions split."""
    out: list[str] = []
    text = re.sub(r"([Cc]#|[Cc]\+\+)['’]s\b", r"\1 is", text or "")
    for m in _PROTECT.finditer(text):
        t = m[0].replace("’", "'")
        low = t.lower()
        for end, full in _ENDINGS.items():
            if low.endswith(end) and len(t) > len(end) and t[0].isalpha() and "(" not in t:
                stem = t[: -len(end)]
                out += [_STEMS.get(stem.lower(), stem), full]
                break
        else:
            out.append(t.rstrip(".,;:!?'\")>") if t.startswith(("http", "ftp")) else t)
    return out


def is_word(token: str) -> bool:
    """Neither punctuation, symbol, number-like, URL nor mail."""
    if _NUMBER.fullmatch(token) or re.match(r"(?:https?|ftp)://|\S+@\S+\.\S+$", token):
        return False
    return any(c.isalnum() for c in token) or (len(token) > 1 and not all(unicodedata.category(c)[0] in "PS" for c in token))


def _twice(text: str | None, form) -> str:
    """Two passes: joined tokens can leave punctuation behind that only a second look takes off."""
    once = " ".join(form(t) for t in code_tokens(text) if is_word(t))
    return " ".join(form(t) for t in code_tokens(once) if is_word(t))


def norm_line(text: str | None) -> str:
    return _twice(text, str.lower)


#: Irregular lemmas; regular ones follow the rules in `lemma`.
_IRREGULAR = {"is": "be", "are": "be", "was": "be", "were": "be", "am": "be", "been": "be", "has": "have", "had": "have", "does": "do", "did": "do", "done": "do", "got": "get", "went": "go", "gone": "go", "ran": "run", "wrote": "write", "written": "write", "threw": "throw", "thrown": "throw", "children": "child", "indices": "index", "better": "good", "best": "good"}


def lemma(word: str) -> str:
    """Rule-based base form of an English word; other tokens in lower case."""
    w = word.lower()
    if w in _IRREGULAR:
        return _IRREGULAR[w]
    if not w.isalpha() or len(w) < 4:
        return w
    for end, put in (("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("shes", "sh"), ("ies", "y"), ("ied", "y")):
        if w.endswith(end):
            return w[: -len(end)] + put
    if w.endswith("s") and not w.endswith(("ss", "us", "is")):
        return w[:-1]
    for end in ("ing", "ed"):
        stem = w[: -len(end)]
        if w.endswith(end) and len(stem) >= 3 and re.search("[aeiouy]", stem):
            if stem[-1] == stem[-2] and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if re.search(r"(?:[^aeiou][aeiou](?:t|v|z|g|c|s|k|r|d|n|m|p)|at|iz|bl|dg|nc|rg|lv|rs)$", stem) and len(stem) > 3 or stem.endswith(("v", "z")) else stem
    return w


def lemma_line(text: str | None) -> str:
    return _twice(text, lemma)


# What stays whole in short informal text, each kind under its own name, in the order they are tried.
SOCIAL = {
    "face": r"(?:\^_\^|[:=8;](?:|o|O|-)(?:[pPb]|[\|doO/\\]|[\(\[]+|[D\)\]]+)|(?:[\(\[]+|[D\)\]]+)(?:|o|O|-)[:=8;])(?!\w)",
    "heart": r"<+/?3+",
    "arrow": r"<*[-=]+>+|<+[-=]+",
    "url": r"\b(?:https?://|www\.|[a-z0-9.-]+?\.(?:com|co\.uk|org|net|info|ca|edu|gov)(?=[/ \W]))[^ \t\r\n<>]*?(?=(?:(?:['“\".?!,(/:;]|&(?:amp|lt|gt|quot);)+?)?(?:\.\.+|[<>]|\s|$))",
    "email": r"(?:[a-zA-Z0-9_+-]+\.)*[a-zA-Z0-9_+-]+@(?:[a-zA-Z0-9]+\.)+(?:com|co\.uk|org|net|info|ca|edu|gov)",
    "entity": r"&(?:amp|lt|gt|quot);",
    "hashtag": r"#[a-zA-Z0-9_]+",
    "mention": r"@[a-zA-Z0-9_]+",
    "time": r"\d+:\d+",
    "decimal": r"\d+\.\d+",
    "thousands": r"(?:\d+,)+?\d{3}(?=[^,]|$)",
    "abbreviation": r"(?:(?:[A-Za-z]\.){2,}|(?:[A-Za-z]\.)+[A-Za-z])(?=\s|[“\"?!,:;]|&(?:amp|lt|gt|quot);)",
    "separator": r"--+|―",
    "decoration": r"[♫]+",
    "apostrophe": r"\S+'\w+",
    "api": r"(?:\w+\.)+\w+\(\)|\w+\(\)|(?:\w+\.)+\w+",
    "punctuation": r"['`\"“”‘’)]+|[.?!,…]+|[:;/(]+",
    "plural": r"\w+\(s\)",
    "operator": r"==|!=|>=|<=|&&|\|\|",
}
#: Whatever lies between them falls apart at white space.
_SOCIAL = re.compile("|".join(f"(?:{p})" for p in SOCIAL.values()))


def social_tokens(text: str | None) -> list[tuple[str, int]]:
    """(token, start) pairs for short informal text: what SOCIAL names stays whole, the rest is split at white space.
    Starts refer to the text given, so tokens always align."""
    text, out, end = text or "", [], 0
    found = [m.span() for m in _SOCIAL.finditer(text) if m.end() > m.start()]
    for start, stop in [*found, (len(text), len(text))]:
        out += [(m[0], end + m.start()) for m in re.finditer(r"\S+", text[end:start])]
        if stop > start:
            out.append((text[start:stop], start))
        end = stop
    return out


def split_sentences(text: str | None) -> list[str]:
    """Sentences end at . ! ? before white space and a capital, digit or quote, or at a blank line; dotted names and
    one-letter abbreviations do not end one."""
    out: list[str] = []
    for block in re.split(r"\n\s*\n", text or ""):
        start = 0
        for m in re.finditer(r"[.!?]+[\"')\]]*\s+(?=[A-Z0-9\"'(`])", block):
            before = block[start : m.start()].rsplit(None, 1)[-1:] or [""]
            if re.fullmatch(r"(?:[A-Za-z]\.)*[A-Za-z]|e\.g|i\.e|etc|vs|cf", before[0]):
                continue
            out.append(block[start : m.end()])
            start = m.end()
        out.append(block[start:])
    return [re.sub(r"\s+", " ", s).strip() for s in out if s.strip()]


def _batched(f, kind: str):
    """A Column function that maps `f` over Arrow batches; null stays null."""

    def apply(c: Column) -> Column:
        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else f(x))

        return run(c)

    return apply


tokenize_code = _batched(code_tokens, "array<string>")
norm_text = _batched(norm_line, "string")
lemma_text = _batched(lemma_line, "string")
tokenize_social = _batched(lambda x: [t for t, _ in social_tokens(x)], "array<string>")
sentences = _batched(split_sentences, "array<string>")


def align_social(c: Column) -> Column:
    """array<struct<token, start>> of a text."""

    @F.pandas_udf("array<struct<token:string,start:int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [{"token": t, "start": i} for t, i in social_tokens(x)])

    return run(c)


# The classifier's mask of line numbers and its tokens.
LINE_NUMBER, MASK = r":[0-9]*\)", ":_xerrx_)"
POST_TOKEN = r"((?U)\b\w\w+\b|[|&#@~_'\"=\\/\-:;*.$()\[\]{}])"


def post_tokens(c: Column) -> Column:
    """The classifier's tokens: words of two or more characters and listed punctuation, line numbers masked."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(c), LINE_NUMBER, MASK), F.lit(POST_TOKEN), F.lit(1))


def ngram_pairs(tokens: Column) -> Column:
    """Neighbouring token pairs of an array, as `a b`."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def merge_phrases(tokens: Column, phrases: Column) -> Column:
    """Greedy left-to-right merging of neighbours whose pair is in `phrases`."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("open"))

    def step(s, t):
        last = F.element_at(s["out"], F.when(F.size(s["out"]) > 0, -1).otherwise(1))
        join = s["open"] & F.array_contains(phrases, F.concat(last, F.lit(" "), t))
        merged = F.concat(F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(F.concat(last, F.lit("_"), t)))
        return F.when(join, F.struct(merged.alias("out"), F.lit(False).alias("open"))).otherwise(
            F.struct(F.concat(s["out"], F.array(t)).alias("out"), F.lit(True).alias("open"))
        )

    return F.aggregate(tokens, start, step, lambda s: s["out"])
