"""Several values packed in one field: a quote-aware finite-state tokenizer.

A `Grammar` names the separators of a field. The automaton has five states - before a value, in a bare value, in
single quotes, in double quotes, in a header - and one counter, the depth of open list brackets. Inside brackets
double-quoted values follow JSON, so a backslash escapes there too; outside, only a doubled quote stands for a quote.
A quote that is never closed in front of a separator is an ordinary character of a bare value.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Grammar:
    """separators: regex of one separator. brackets: `[` and `]` may wrap the list. header: regex of what belongs
    to no value, looked for at the start of the field and behind every separator that matches `reopens`."""

    separators: str
    brackets: bool = False
    header: str = ""
    reopens: str = ""
    _made: dict = field(default_factory=dict, compare=False, repr=False)

    def compiled(self) -> tuple:
        if not self._made:
            sep = rf"(?:{self.separators})"
            close = rf"(?=\s*(?:{sep}|\Z))"
            inner = rf"(?=\s*(?:{sep}|\]|\Z))"
            made = {
                "gap": re.compile(rf"(?:{sep}|\s)"),
                "stop": re.compile(sep),
                "stop_in": re.compile(rf"{sep}|\]"),
                "double": re.compile(rf'"((?:[^"]|"")*+)"{close}'),
                "json": re.compile(rf'"((?:[^"\\]|\\.|"")*+)"{inner}', re.S),
                "single": re.compile(rf"'([^']*(?:'(?!\s*(?:{sep}|\Z))[^']*)*)'{close}"),
                "single_in": re.compile(rf"'([^']*)'{inner}"),
                "header": re.compile(self.header) if self.header else None,
                "reopens": re.compile(self.reopens) if self.reopens else None,
            }
            self._made.update(made)
        return self._made


_MARK = r"(?i:(?:<|\[|&lt;)_{0}_\s*/?(?:>|\]|&gt;))"
_CODE, _POST, _ENT = _MARK.format("code"), _MARK.format("post"), _MARK.format("ent")

TAGS = Grammar(r"[<>,;|\s]|&lt;|&gt;", brackets=True)
ENTITIES = Grammar(rf"{_ENT}|[,;|\t\r\n]", brackets=True)
SNIPPETS = Grammar(
    rf"{_CODE}|{_POST}",
    header=rf"\s*Post:(?:(?!{_CODE}|{_POST})[^\n])*(?:\n\s*##Score(?:(?!{_CODE}|{_POST})[^\n])*)?|\s*##Score(?:(?!{_CODE}|{_POST})[^\n])*",
    reopens=_POST,
)
QUESTION_FIELDS = {"Tags": TAGS, "Entities": ENTITIES, "Snippets": SNIPPETS}


def tokenize(text: str | None, grammar: Grammar) -> list[str]:
    """The values of one packed field in order. Null and empty text give an empty list."""
    if not text:
        return []
    g, out, i, depth, n = grammar.compiled(), [], 0, 0, len(text)
    if g["header"] and (m := g["header"].match(text)):
        i = m.end()
    while i < n:
        if m := g["gap"].match(text, i):
            i = m.end()
            if g["reopens"] and g["reopens"].fullmatch(m[0]) and (m := g["header"].match(text, i)):
                i = m.end()
            continue
        c = text[i]
        if grammar.brackets and c == "[":
            depth, i = depth + 1, i + 1
            continue
        if depth and c == "]":
            depth, i = depth - 1, i + 1
            continue
        value = None
        if c == '"':
            if depth and (m := g["json"].match(text, i)):
                try:
                    value = json.loads('"' + m[1].replace('""', '\\"') + '"', strict=False)
                except ValueError:
                    value = m[1]
            elif m := g["double"].match(text, i):
                value = m[1].replace('""', '"')
        elif c == "'" and (m := g["single_in" if depth else "single"].match(text, i)):
            value = m[1]
        if value is None:
            m = g["stop_in" if depth else "stop"].search(text, i)
            end = m.start() if m else n
            value, i = text[i:end].rstrip(), end
        else:
            i = m.end()
        if value:
            out.append(value)
    return out


def split_packed(df: DataFrame, key: str, fields: Mapping[str, Grammar]) -> DataFrame:
    """(field, id, pos, item): one row per value of the packed columns `fields`, pos from 1 within id and field.

    Null or empty fields and fields of separators alone give no rows; a repeated value comes out at each of its
    positions; a value may be as long as the text. Other columns of `df` are not read. One pass, no shuffle.
    """
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for k, name in enumerate(names, 1):
                rows, pos, items = [], [], []
                for r, text in enumerate(batch.column(k).to_pylist()):
                    if text:
                        values = tokenize(text, fields[name])
                        rows += [r] * len(values)
                        pos += range(1, len(values) + 1)
                        items += values
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(rows)), ids.take(pa.array(rows)), pa.array(pos, pa.int32()), pa.array(items, pa.string())],
                        ["field", "id", "pos", "item"],
                    )

    return df.select(key, *names).mapInArrow(run, f"field string, id {dict(df.dtypes)[key]}, pos int, item string")
