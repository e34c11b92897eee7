"""Markup residue in text documents: one parser for HTML, Markdown, wiki and LaTeX text, and tag-path ratios.

A text becomes a list of nodes in reading order, each with its root-to-leaf tag path; lines of Markdown, wiki and LaTeX
get the paths their HTML would have. Code blocks are cut out first, so nothing inside them counts as markup.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

UNITS = ("heading", "list_item", "code_block", "formula")


class Node(NamedTuple):
    path: str
    kind: str  # text, code, or one of UNITS
    text: str
    level: int = 0


_KNOWN = "p|br|hr|a|b|i|u|s|em|strong|code|kbd|tt|ul|ol|li|h[1-6]|blockquote|div|span|table|thead|tbody|tr|td|th|img|sub|sup|del|ins|dl|dt|dd|nav|script|style|pre|math|font|center|small|big|cite|q|abbr|section|article|header|footer"
#: Tags that make a text HTML, unless they stand in a string literal; the weak ones occur in wiki text and Markdown too.
_HTML_BLOCK = re.compile(r"(?<![\"'])<(?:p|br|hr|ul|ol|li|h[1-6])\b[^<>]*/?>", re.I)
_INDENTED = re.compile(r"^(?: {4}|\t).*$", re.M)
_ESCAPED = re.compile(r"\s*&lt;(?:p|pre|ul|ol|h[1-6]|blockquote|div|table|code|b|i|em|strong|a)\b[^<>]*?&gt;", re.I)
_HTML_INLINE = re.compile(r"<(?:a\s[^<>]*|strong|em|b|i)>", re.I)
_TEX = re.compile(r"\\(?:(?:sub)*section\*?\{|(?:textbf|texttt|textit|emph|href)\{|begin\{(?:itemize|enumerate|verbatim|lstlisting|minted|quote|equation|align|description)\*?\})")
_WIKI = re.compile(r"^={1,6}[^=\n].*?=+[ \t]*$|'''|''\S|\{\{mono\||<tt>|<source\b|<syntaxhighlight\b|<math\b|\[\[\s*https?://|\[https?://\S+ [^\]\n]+\]|<pre>[ \t]*\n", re.I | re.M)
#: Openers of code blocks, and inline code, which hides openers. Group names tell which.
_FENCE = r"^[ ]{0,3}(?P<fence>`{3,}|~{3,})[^\n`]*$"
_OPEN = re.compile(
    _FENCE
    + r"|(?P<tick>(?<!`)(?P<ticks>`+)(?!`)(?:(?!\n[ \t]*\n)[\s\S])*?(?<!`)(?P=ticks)(?!`))"
    + r"|<(?P<tag>pre|source|syntaxhighlight)\b[^<>]*>"
    + r"|\\begin\{(?P<env>verbatim|lstlisting|minted)\*?\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?"
    + r"|(?P<inline><(?P<itag>code|tt|nowiki)\b[^<>]*>[\s\S]*?</(?P=itag)>)"
    + r"|(?P<comment><!--[\s\S]*?(?:-->|\Z))",
    re.I | re.M,
)
_OPEN_HTML = re.compile(
    _FENCE + r"|<(?P<tag>pre|source|syntaxhighlight)\b[^<>]*>|(?P<inline><(?P<itag>code|tt|nowiki)\b[^<>]*>[\s\S]*?</(?P=itag)>)|(?P<comment><!--[\s\S]*?(?:-->|\Z))|(?P<tick>(?!))|(?P<env>(?!))", re.I | re.M
)
_FORMULA = re.compile(
    r"(?<![\\$])\$\$(?P<a>[^$]+?)(?:\$\$|\Z)"
    r"|\\\[(?P<b>[\s\S]+?)(?:\\\]|\Z)"
    r"|\\\((?P<c>[\s\S]+?)\\\)"
    r"|<math\b[^<>]*>(?P<d>[\s\S]+?)(?:</math>|\Z)"
    r"|\\begin\{(?P<env>equation|align|displaymath|math|eqnarray|gather)\*?\}(?P<e>[\s\S]+?)(?:\\end\{(?P=env)\*?\}|\Z)"
    r"|(?<![\\$\w])\$(?=[^\s$])(?P<f>[^$\n]*?[^\s$\\])\$(?![\d$])",
    re.I,
)
_TAG = re.compile(rf"<(?P<end>/?)(?P<name>{_KNOWN})\b(?P<rest>[^<>]*)>", re.I)
_VOID = {"br", "hr", "img"}
_SILENT = {"script", "style"}
_BLOCK = {"p", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "div", "table", "tr", "td", "th", "dl", "dt", "dd", "hr", "section", "article", "nav", "header", "footer"}
_ATX = re.compile(r"[ ]{0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$")
_ITEM = re.compile(r"(\s*)(?:[-*+]|\d{1,9}[.)])[ \t]+(\S.*)$")
_WIKI_ITEM = re.compile(r"([*#]+)[:;]?\s*([^\s*#].*)$")
_WIKI_HEAD = re.compile(r"(={1,6})\s*([^=\s].*?)\s*=+\s*$")
_TEX_HEAD = re.compile(r"\\((?:sub)*section|chapter|paragraph)\*?\{([^{}]*)\}")
_HOLE = "\x00"


def _cut(text: str, opener: re.Pattern) -> tuple[str, list[tuple[str, str]]]:
    """The text with code blocks, inline code and comments taken out, a hole mark in the place of each."""
    if not opener.search(text):
        return text, []
    out, pieces, i, n = [], [], 0, len(text)
    while m := opener.search(text, i):
        out.append(text[i : m.start()])
        end = m.end()
        if m["comment"] is not None:
            i = end
            continue
        if m["tick"] is not None:
            kind, body = "code", m["tick"].strip("`").strip()
        elif m["inline"] is not None:
            kind, body = "code", re.sub(r"^<[^<>]*>|<[^<>]*>$", "", m["inline"])
        else:
            kind = "code_block"
            if m["fence"] is not None:
                close = re.compile(rf"^[ ]{{0,3}}{re.escape(m['fence'][0])}{{{len(m['fence'])},}}[ \t]*$", re.M)
            elif m["tag"] is not None:
                close = re.compile(rf"</{m['tag']}\s*>", re.I)
            else:
                close = re.compile(rf"\\end\{{{m['env']}\*?\}}", re.I)
            c = close.search(text, end)
            body, end = text[end : c.start() if c else n], c.end() if c else n
            if m["tag"] is not None:
                body = re.sub(r"^\s*<code\b[^<>]*>|</code>\s*$", "", body, flags=re.I)
        pieces.append((kind, body))
        out.append(f"{_HOLE}{len(pieces) - 1}{_HOLE}")
        i = end
    out.append(text[i:])
    return "".join(out), pieces


_PLAIN = re.compile(r"[<>&`~$\\=#*+'\[{|_\x00]|^[ \t]*(?:[-+*]|\d+[.)])[ \t]|^(?: {4}|\t)|^-{2,}", re.M)
_HOLES = re.compile(rf"{_HOLE}(\d+){_HOLE}")


def parse(text: str | None) -> list[Node]:
    """Nodes of one text. Null and blank text have none."""
    if not text or not text.strip():
        return []
    if not _PLAIN.search(text):
        return [Node("p", "text", p) for p in re.split(r"\n\s*\n", text) if p.strip()]
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace(_HOLE, " ")
    if "&lt;" in text and _ESCAPED.match(text):
        text = html.unescape(text)
    held, pieces = _cut(text, _OPEN)
    loose = _INDENTED.sub("", held) if "\n    " in held or held[:4] == "    " or "\t" in held else held
    is_html = bool(_HTML_BLOCK.search(loose)) or (bool(_HTML_INLINE.search(loose)) and not _WIKI.search(loose))
    if is_html:
        held, pieces = _cut(text, _OPEN_HTML)
    held, pieces = _take_formulas(held, pieces)
    if is_html:
        return _html_nodes(held, pieces)
    if _TEX.search(text):
        return _line_nodes(held, pieces, "tex")
    return _line_nodes(held, pieces, "wiki" if _WIKI.search(text) else "markdown")


def _take_formulas(held: str, pieces: list) -> tuple[str, list]:
    if "$" not in held and "\\" not in held and "<math" not in held.lower():
        return held, pieces

    def hole(m: re.Match) -> str:
        body = next(g for g in m.group("a", "b", "c", "d", "e", "f") if g is not None)
        if not body.strip():
            return m[0]
        pieces.append(("formula", body.strip()))
        return f"{_HOLE}{len(pieces) - 1}{_HOLE}"

    return _FORMULA.sub(hole, held), pieces


def _inline(text: str, path: str, pieces: list, nodes: list[Node], clean=None) -> None:
    """Text with holes as nodes under `path`."""
    i = 0
    for m in _HOLES.finditer(text):
        _text(text[i : m.start()], path, nodes, clean)
        kind, body = pieces[int(m[1])]
        leaf = {"code": "code", "code_block": "pre", "formula": "math"}[kind]
        nodes.append(Node(f"{path}/{leaf}", kind, html.unescape(body) if kind != "formula" else body))
        i = m.end()
    _text(text[i:], path, nodes, clean)


def _text(text: str, path: str, nodes: list[Node], clean) -> None:
    if clean:
        text = clean(text)
    if text.strip():
        nodes.append(Node(path, "text", text))


def _html_nodes(held: str, pieces: list) -> list[Node]:
    nodes: list[Node] = []
    stack: list[str] = []
    i = 0

    def emit(chunk: str) -> None:
        _inline(chunk, "/".join(stack) or "body", pieces, nodes, html.unescape)

    for m in _TAG.finditer(held):
        if not stack or stack[-1] not in _SILENT:
            emit(held[i : m.start()])
        i, name = m.end(), m["name"].lower()
        if m["end"]:
            if name in stack:
                del stack[len(stack) - 1 - stack[::-1].index(name) :]
            continue
        if name in _VOID:
            if name in ("br", "hr"):
                nodes.append(Node("/".join([*stack, name]), "break", "\n"))
            continue
        if name in _BLOCK:
            while stack and (stack[-1] == "p" or (stack[-1] == name and name in ("li", "tr", "td", "dt", "dd"))):
                stack.pop()
            if name == "li" and "li" in stack and not any(x in ("ul", "ol") for x in stack[stack.index("li") + 1 :]):
                del stack[stack.index("li") :]
        if not m["rest"].rstrip().endswith("/"):
            stack.append(name)
        path = "/".join(stack)
        if name == "li":
            nodes.append(Node(path, "list_item", ""))
        elif name[0] == "h" and name[1:].isdigit():
            nodes.append(Node(path, "heading", "", int(name[1:])))
        elif name in _BLOCK:
            nodes.append(Node(path, "break", "\n\n"))
    if not stack or stack[-1] not in _SILENT:
        emit(held[i:])
    return nodes


_MD_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_MD_MARK = re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1|(?<![\w*])\*(?=\S)([^*\n]+?)(?<=\S)\*(?!\w)")
_WIKI_LINK = re.compile(r"\[\[\s*https?://[^|\]\s]*\|([^\]]*)\]\]|\[https?://\S+\s+([^\]\n]*)\]|\[\[(?:[^|\]]*\|)?([^\]|]*)\]\]")
_TEX_WRAP = re.compile(r"\\(?:textbf|texttt|textit|emph|underline)\{([^{}]*)\}|\\href\{[^{}]*\}\{([^{}]*)\}|\\(?:begin|end)\{[^{}]*\}")


def _clean_markdown(t: str) -> str:
    t = _MD_LINK.sub(r"\1", t)
    return html.unescape(_MD_MARK.sub(lambda m: m[2] or m[3] or "", t))


def _clean_wiki(t: str) -> str:
    t = re.sub(r"'{2,5}", "", t)
    t = re.sub(r"\{\{\w+\|([^{}]*)\}\}", r"\1", t)
    t = _WIKI_LINK.sub(lambda m: m[1] or m[2] or m[3] or "", t)
    return html.unescape(re.sub(rf"</?(?:{_KNOWN})\b[^<>]*>", "", t, flags=re.I))


def _clean_tex(t: str) -> str:
    t = _TEX_WRAP.sub(lambda m: m[1] or m[2] or "", t)
    return re.sub(r"\\([%$&#_{}])", r"\1", t)


_CLEAN = {"markdown": _clean_markdown, "wiki": _clean_wiki, "tex": _clean_tex}


def _line_nodes(held: str, pieces: list, dialect: str) -> list[Node]:
    """Line by line: a paragraph ends at a blank line, a heading, an item or a code block."""
    nodes: list[Node] = []
    clean = _CLEAN[dialect]
    lines = held.split("\n")
    para: list[str] = []
    in_list, fresh, k = False, True, 0

    def flush(path: str = "p") -> None:
        if para:
            _inline("\n".join(para), path, pieces, nodes, clean)
            nodes.append(Node(path, "break", "\n\n"))
            para.clear()

    def item(body: str) -> None:
        flush()
        nodes.append(Node("ul/li", "list_item", ""))
        _inline(body, "ul/li", pieces, nodes, clean)

    def heading(level: int, body: str) -> None:
        flush()
        nodes.append(Node(f"h{level}", "heading", "", level))
        _inline(body, f"h{level}", pieces, nodes, clean)
        nodes.append(Node(f"h{level}", "break", "\n\n"))

    while k < len(lines):
        line = lines[k]
        k += 1
        if not line.strip():
            flush()
            fresh = True
            continue
        if dialect == "tex":
            line = re.sub(r"\\(?:begin|end)\{(?:itemize|enumerate|description|quote|center|document)\*?\}", "", line)
            if m := _TEX_HEAD.search(line):
                heading(m[1].count("sub") + 1, m[2])
                line = line[: m.start()] + line[m.end() :]
            parts = re.split(r"\\item\b(?:\[[^\]]*\])?", line)
            if parts[0].strip():
                para.append(parts[0])
            for part in parts[1:]:
                item(part)
            continue
        if dialect == "wiki":
            if m := _WIKI_HEAD.match(line):
                heading(len(m[1]), m[2])
                continue
            if m := _WIKI_ITEM.match(line):
                item(m[2])
                continue
            para.append(line)
            continue
        # Markdown
        if fresh and not para and re.match(r"(?: {4}|\t)\s*\S", line) and not (in_list and _ITEM.match(line)):
            block = [line]
            while k < len(lines) and (not lines[k].strip() or re.match(r"(?: {4}|\t)", lines[k])):
                block.append(lines[k])
                k += 1
            body = "\n".join(re.sub(r"^(?: {4}|\t)", "", x) for x in block).rstrip()
            nodes.append(Node("pre", "code_block", _HOLES.sub(lambda m: pieces[int(m[1])][1], body)))
            in_list, fresh = False, True
            continue
        if (m := _ATX.match(line)) and not _numbered_by_hash(lines, k - 1):
            heading(len(m[1]), m[2])
            in_list, fresh = False, True
            continue
        if not para and k < len(lines) and re.fullmatch(r"[ ]{0,3}(?:={2,}|-{2,})[ \t]*", lines[k]) and not _ITEM.match(line) and fresh:
            heading(1 if "=" in lines[k] else 2, line.strip())
            k += 1
            in_list, fresh = False, True
            continue
        m = _ITEM.match(line)
        if m and (fresh or in_list) and (len(m[1]) < 4 or in_list):
            item(m[2])
            in_list, fresh = True, False
            continue
        if fresh and (m := re.match(r"([*#])\1*(?=[^\s*#])(.*)$", line)) and _run_of(lines, k - 1, m[1]):
            while k <= len(lines) and (m := re.match(r"[*#]+\s*(\S.*)$", lines[k - 1])):
                item(m[1])
                k += 1
            k -= 1
            in_list, fresh = True, False
            continue
        if _numbered_by_hash(lines, k - 1) and (m := re.match(r"#\s*(\S.*)$", line)):
            item(m[1])
            in_list, fresh = True, False
            continue
        if not line.startswith((" ", "\t")) and fresh:
            in_list = False
        para.append(re.sub(r"^[ ]{0,3}>[ ]?", "", line))
        fresh = False
    flush()
    return nodes


def _numbered_by_hash(lines: list[str], k: int) -> bool:
    """A line of a wiki list: its neighbour begins with a single # as well."""
    one = re.compile(r"#(?!#)\s*\S")
    near = [lines[j] for j in (k - 1, k + 1) if 0 <= j < len(lines)]
    return bool(one.match(lines[k])) and any(one.match(x) for x in near)


def _run_of(lines: list[str], k: int, mark: str) -> bool:
    return k + 1 < len(lines) and lines[k + 1].startswith(mark)


_LINKED = {"a", "nav"}


def _smooth(x: np.ndarray, width: int) -> np.ndarray:
    """Triangular window of 2*width+1 over a row of any length; at its ends over the part of the window that is there."""
    kernel = np.concatenate([np.arange(1, width + 2), np.arange(width, 0, -1)]).astype(float)
    inside = slice(width, width + len(x))
    return np.convolve(x, kernel)[inside] / np.convolve(np.ones(len(x)), kernel)[inside]


def _middle(x: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The lower median of x for each code 0.. ."""
    order = np.lexsort((x, code))
    many = np.bincount(code)
    return x[order][np.cumsum(many) - many + (many - 1) // 2]


def select_content(nodes: list[Node], alpha: float = 0.002, width: int = 2) -> list[Node]:
    """The content nodes, by tag-path ratios. Per path: text length and punctuation over its number of nodes; text of
    links and navigation counts as none. Both ratios are smoothed over neighbouring nodes, fused as their product, and a
    path's median is held against alpha times the mean of the document: single links between text reach it by their
    neighbours, long runs of links do not, and go, with the list items that held nothing else. What stands in one line
    with text that is kept stays, and so does text of its own in a heading or item, code blocks and formulas. A document
    of a single path is all content."""
    at = [i for i, n in enumerate(nodes) if n.kind in ("text", "code")]
    paths: dict[str, int] = {}
    code = np.array([paths.setdefault(nodes[i].path, len(paths)) for i in at], dtype=int)
    if len(paths) < 2:
        return nodes
    linked = {p for p in paths if not _LINKED.isdisjoint(p.split("/"))}
    own = [0 if nodes[i].path in linked else 1 for i in at]
    size = np.array([len(nodes[i].text.strip()) * w for i, w in zip(at, own)], dtype=float)
    marks = np.array([sum(map(nodes[i].text.count, ".,;:!?")) * w for i, w in zip(at, own)], dtype=float)
    many = np.bincount(code)
    ratio, points = np.bincount(code, size) / many, np.bincount(code, marks) / many
    fused = _smooth(ratio[code], width) * (1 + _smooth(points[code], width))
    keep = _middle(fused, code) >= alpha * fused.mean()
    if keep.all():
        return nodes
    # a line is what stands between two block boundaries
    line = np.cumsum([n.kind in ("break", "list_item", "heading", "code_block") for n in nodes])
    units = {n.path for n in nodes if n.kind in UNITS}
    kept = {p for p, c in paths.items() if p not in linked and (keep[c] or p in units)}
    anchored = {line[i] for i in at if nodes[i].path in kept and nodes[i].text.strip()}
    gone = {i for i, c in zip(at, code) if not (keep[c] or nodes[i].path in kept or line[i] in anchored)}
    filled = {line[i] for i, n in enumerate(nodes) if i not in gone and n.kind in ("text", "code", "formula") and n.text.strip()}
    emptied = {line[i] for i in gone} - filled
    return [n for i, n in enumerate(nodes) if i not in gone and not (n.kind == "list_item" and line[i] in emptied)]


def render(nodes: list[Node]) -> str:
    """Clean text: # headings, - items, fenced code blocks, $ formulas; the rest as plain paragraphs."""
    out: list[str] = []
    for n in nodes:
        if n.kind == "heading":
            out.append("\n\n" + "#" * max(1, n.level) + " ")
        elif n.kind == "list_item":
            out.append("\n- ")
        elif n.kind == "code_block":
            out.append(f"\n\n```\n{n.text.strip(chr(10))}\n```\n\n")
        elif n.kind == "formula":
            out.append(f"${n.text}$")
        elif n.kind == "break":
            out.append(n.text)
        else:
            out.append(re.sub(r"\s+", " ", n.text))
    return re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", "".join(out))).strip()


def count_units(nodes: list[Node]) -> tuple[int, int, int, int]:
    """Headings, items, code blocks and formulas; one without any text in it is none."""
    heading = item = block = formula = 0
    for i, n in enumerate(nodes):
        if n.kind == "formula":
            formula += 1
        elif n.kind == "code_block":
            block += bool(n.text.strip())
        elif n.kind in ("heading", "list_item"):
            filled = False
            for other in nodes[i + 1 :]:
                if other.kind in ("heading", "list_item") or not other.path.startswith(n.path):
                    break
                if other.kind != "break":
                    filled = True
                    break
            if n.kind == "heading":
                heading += filled
            else:
                item += filled
    return heading, item, block, formula


def clean_markup(df: DataFrame, key: str, text: str, with_text: bool = True) -> DataFrame:
    """(id, clean, heading, list_item, code_block, formula): every row's clean text and its number of units.

    `clean` keeps headings, items, code blocks and formulas recognisable (see render) and is null without
    `with_text`. HTML, Markdown, wiki and LaTeX texts, also escaped once too often; a block left open lasts to the
    end; text inside code is never markup. Null and blank texts give empty clean text and no units. Content is
    selected by tag-path ratios inside each document, so there is no shuffle; one row out per row in; rows with a
    null key stay; whole texts of any length; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, counts = [], []
            for t in batch.column(1).to_pylist():
                nodes = select_content(parse(t))
                counts.append(count_units(nodes))
                clean.append(render(nodes) if with_text else None)
            columns = zip(*counts) if counts else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), *(pa.array(c, pa.int32()) for c in columns)], ["id", "clean", *UNITS])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"id {kind}, clean string, " + ", ".join(f"{u} int" for u in UNITS))
