"""Markup of post bodies: visible text and code parts, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SILENT = {"script", "style"}
_BREAKS = {"p", "br", "li", "pre", "div", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "blockquote", "hr"}


class _Reader(HTMLParser):
    """Collects visible text, code parts, and text outside a dropped tag."""

    def __init__(self, part: str, drop: str | None, replace=None) -> None:
        super().__init__(convert_charrefs=True)
        self.part, self.drop, self.replace = part, drop, replace
        self.out: list[str] = []
        self.parts: list[str] = []
        self.held: list[str] = []
        self.depth = self.dropped = self.silent = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _SILENT:
            self.silent += 1
        if tag == self.drop:
            self.dropped += 1
        if tag == self.part:
            self.depth += 1
            if self.depth == 1:
                self.held = []

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT and self.silent:
            self.silent -= 1
        if tag == self.drop and self.dropped:
            self.dropped -= 1
        if tag == self.part and self.depth:
            self.depth -= 1
            if not self.depth:
                self._part()

    def _part(self) -> None:
        text = "".join(self.held)
        if text.strip():
            self.parts.append(text.strip())
        if self.replace:
            self.out.append(f" {self.replace(text)} ")

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.depth:
            self.held.append(data)
            if self.replace:
                return
        if not self.dropped:
            self.out.append(data)

    def close(self) -> None:
        super().close()
        if self.depth:
            self._part()


def read_html(text: str | None, part: str = "code", drop: str | None = None, replace=None) -> tuple[str, list[str]]:
    """(visible text, non-empty texts of each `part` element). A part left open lasts to the end."""
    if not text:
        return "", []
    if "<" not in text:
        return html.unescape(text), []
    r = _Reader(part, drop, replace)
    r.feed(text)
    r.close()
    return "".join(r.out), r.parts


def html_text(c: Column) -> Column:
    """Visible text of an HTML fragment; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else read_html(x)[0])

    return run(c)


def drop_element(c: Column, tag: str = "pre") -> Column:
    """Visible text without the subtrees of `tag`."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else read_html(x, drop=tag)[0])

    return run(c)


def extract_parts(c: Column, tag: str = "code") -> Column:
    """Non-empty, stripped texts of each `tag` element."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else read_html(x, tag)[1])

    return run(c)


def replace_pre(c: Column, tag: str = "pre") -> Column:
    """Visible text in which each `tag` element is its API tokens: each once, without prefixes, apart by blanks; code that
    does not parse or has none leaves nothing."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        from askloom.functions.code import sequence_tokens

        return s.map(lambda x: None if x is None else read_html(x, tag, replace=lambda code: " ".join(sequence_tokens(code, unique=True)))[0])

    return run(c)
