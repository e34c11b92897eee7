"""Java-like snippets: a lexer, a check whether a snippet is code, its normal form and its API sequence.

A snippet is tried as a compilation unit, as class members, then as statements. The check is a scan over tokens with
a bracket stack and adjacency rules, not a compiler; types are known for declared names, imports and literals only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The results of code that does not parse and of code without entries.
ERROR, EMPTY = "__ERROR__", "__EMPTY__"
_LEX = re.compile(
    r"(?P<space>\s+)"
    r"|(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\.)*\")"
    r"|(?P<char>'(?:[^'\\\n]|\\(?:u[0-9A-Fa-f]{4}|[0-7]{1,3}|.))')"
    r"|(?P<double>(?:\d[\d_]*\.\d*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdD]?|\d[\d_]*(?:[eE][+-]?\d+[fFdD]?|[fFdD]))"
    r"|(?P<long>(?:0[xX][0-9A-Fa-f_]+|0[bB][01_]+|\d[\d_]*)[lL])"
    r"|(?P<integer>0[xX][0-9A-Fa-f_]+|0[bB][01_]+|\d[\d_]*)"
    r"|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)"
    r"|(?P<op>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|[-+*/%&|^]=|[-+*/%&|^!~<>=?:;,.(){}\[\]@])"
)
_PRIMITIVE = {"byte", "short", "int", "long", "float", "double", "char", "boolean", "void", "var"}
_MODIFIER = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default"}
_WORD_BEFORE = {"return", "throw", "new", "else", "do", "case", "assert", "instanceof", "extends", "implements", "throws", "import", "package", "class", "interface", "enum", "try", "finally", "break", "continue", "goto", "super"} | _MODIFIER
_HEADS = {"if", "for", "while", "switch", "catch", "synchronized", "try"}
_SKIPPED_CALLS = {"print", "println", "printStackTrace"}
# What a comment entry loses, what its body must not begin with.
_COMMENT_MARKS, _LINE_STARS, _GENERATED = r"^(?://|/\*)|\*/$", r"(?m)^ ?\* ?", "TODO Auto-generated"
_NO_CALL = _HEADS | {"return", "throw", "new", "super", "this", "assert", "case", "else", "do", "instanceof"}


@dataclass(frozen=True)
class Tok:
    kind: str
    text: str
    at: int


def lex(code: str) -> list[Tok] | None:
    """All tokens with comments, or None where a character fits no token."""
    out, i = [], 0
    while i < len(code):
        m = _LEX.match(code, i)
        if not m:
            return None
        if m.lastgroup != "space":
            kind = m.lastgroup or ""
            if kind == "name" and m[0] in ("true", "false"):
                kind = "boolean"
            elif kind == "name" and m[0] == "null":
                kind = "null"
            out.append(Tok(kind, m[0], i))
        i = m.end()
    return out


def _balanced(toks: list[Tok]) -> bool:
    stack = []
    pairs = {")": "(", "]": "[", "}": "{"}
    for t in toks:
        if t.kind == "op" and t.text in "([{":
            stack.append(t.text)
        elif t.kind == "op" and t.text in pairs and (not stack or stack.pop() != pairs[t.text]):
            return False
    return not stack


def _type_end(toks: list[Tok], i: int) -> int:
    """End of a type starting at i, or i if there is none: name(.name)*, type arguments, array brackets."""
    if i >= len(toks) or toks[i].kind != "name" or toks[i].text in (_WORD_BEFORE | _HEADS | {"this"}):
        return i
    j = i + 1
    while j + 1 < len(toks) and toks[j].text == "." and toks[j + 1].kind == "name":
        j += 2
    if j < len(toks) and toks[j].text == "<":
        depth, k = 0, j
        while k < len(toks):
            x = toks[k]
            if x.text == "<":
                depth += 1
            elif x.text == ">":
                depth -= 1
                if not depth:
                    j = k + 1
                    break
            elif not (x.kind == "name" or x.text in (",", ".", "?", "&", "[", "]", "@")):
                return i
            k += 1
        else:
            return i
    while j + 1 < len(toks) and toks[j].text == "[" and toks[j + 1].text == "]":
        j += 2
    return j


def _declared(toks: list[Tok]) -> list[tuple[int, str, bool]]:
    """(token index of a declared name, type text, whether it is a field or local variable) in order."""
    found, i = [], 0
    while i < len(toks):
        before = toks[i - 1] if i else None
        j = _type_end(toks, i)
        fits = before is None or before.text in (";", "{", "}", "(", ",", ")", "...", ":", "->") or before.text in _MODIFIER or before.kind == "comment"
        if j > i and fits and j < len(toks) and toks[j].kind == "name" and toks[j].text not in (_WORD_BEFORE | _HEADS):
            after = toks[j + 1].text if j + 1 < len(toks) else ""
            if after in ("=", ";", ",", ":", ")"):
                text = _join_type(toks[i:j])
                found.append((j, text, after in ("=", ";", ",") and not (before and before.text in ("(", ",") and after in (",", ")"))))
                i = j + 1
                continue
        i += 1
    return found


def _join_type(toks: list[Tok]) -> str:
    return re.sub(r",(?=\S)", ", ", "".join(t.text for t in toks)).replace(", ", ",")


def _operands_ok(toks: list[Tok]) -> bool:
    """No two operands side by side but in declarations, casts and after words that want one; operators have operands."""
    names = {k for k, _, _ in _declared(toks)}
    starts = set()
    for k in names:
        starts.add(k)
    for i in range(1, len(toks)):
        a, b = toks[i - 1], toks[i]
        left = a.kind not in ("op", "comment") or a.text == "]"
        right = b.kind not in ("op", "comment")
        noted = i > 1 and toks[i - 2].text == "@"  # the name of an annotation
        if left and right and not noted and i not in starts and a.text not in _WORD_BEFORE and b.text not in ("instanceof", "extends", "implements", "throws", "super") and a.text not in _PRIMITIVE:
            if not (i + 1 < len(toks) and toks[i + 1].text == "(" and _type_end(toks, i - 1) >= i) and a.text not in ("default",):
                return False
        if a.kind == "op" and b.kind == "op" and a.text in ("*", "/", "%", "=", "==", "!=", "&&", "||", "+=", "-=") and b.text in (")", "]", "}", ";", ",", "*", "/", "%", "==", "!=", "&&", "||"):
            return False
        if a.text == "." and b.kind != "name" and b.text not in ("<", "*"):
            return False
        if b.text == "." and a.kind == "op" and a.text not in (")", "]", "}", ">"):
            return False
    return True


def _ended(toks: list[Tok]) -> bool:
    """Statements end with ; or a block; what stands before a closing brace ended as well."""
    real = [t for t in toks if t.kind != "comment"]
    if not real:
        return True
    if real[-1].text not in (";", "}"):
        return False
    depth, arrays = 0, []
    for a, b in zip(real, real[1:]):
        if a.text in ("(", "["):
            depth += 1
        elif a.text in (")", "]"):
            depth -= 1
        if b.text == "{":
            arrays.append(a.text in ("=", "]", ",", "{") and a.text != "{" or (a.text == "{" and bool(arrays) and arrays[-1]) or a.text == "(")
        elif b.text == "}":
            inside = arrays.pop() if arrays else False
            if not inside and a.text not in (";", "{", "}") and not (a.kind == "name" and depth == 0 and _in_enum(real)):
                return False
    return True


def _in_enum(toks: list[Tok]) -> bool:
    return any(t.text == "enum" for t in toks)


_SIMPLE = re.compile(r"^(?:(?:package|import)\b|@|(?:public|protected|private|static|final|abstract|strictfp)\b|(?:class|interface|enum)\b)")


def parse_wrap(code: str) -> tuple[int, list[Tok] | None]:
    """(0 compilation unit, 1 class members, 2 statements, -1 no code; tokens). The first form that fits wins."""
    toks = lex(code)
    if toks is None or not _balanced(toks):
        return -1, None
    real = [t for t in toks if t.kind != "comment"]
    if not real:
        return 0, toks
    if not _ended(toks) or not _operands_ok(real):
        return -1, None
    heads, depth, head = [], 0, []
    for t in real:
        if not depth:
            head.append(t)
        if t.text in "({[" and t.kind == "op":
            depth += 1
        elif t.text in ")}]" and t.kind == "op":
            depth -= 1
            if not depth and t.text == "}":
                heads.append(head)
                head = []
        if not depth and t.text == ";":
            heads.append(head)
            head = []
    if head:
        heads.append(head)
    texts = [[t.text for t in h] for h in heads]
    if all(h[0] in ("package", "import") or {"class", "interface", "enum"} & set(h) or h == [";"] for h in texts):
        return 0, toks
    if all(_is_member(h) for h in texts):
        return 1, toks
    if any(h[0] in ("package", "import") for h in texts) or any(h[0] in ("public", "private", "protected") for h in texts):
        return -1, None
    return 2, toks


def _is_member(h: list[str]) -> bool:
    """A field, method, type or initializer at the top: a declaration, not a call or a control statement."""
    words = [x for x in h if re.fullmatch(r"[A-Za-z_$][\w$]*", x)]
    if {"class", "interface", "enum", "import"} & set(h) or h[0] in ("@", "{"):
        return h[0] not in ("import", "{")
    if not words or words[0] in _HEADS | {"return", "throw", "new", "do", "else", "this"}:
        return False
    body = [w for w in words if w not in _MODIFIER]
    if len(body) < 2 and not (_MODIFIER & set(words)):
        return False
    if "(" in h:
        k = h.index("(")
        return h[-1] != ";" and k >= 2 and "=" not in h[:k] and "." not in h[:k] or bool({"abstract", "native"} & set(words))
    return h[-1] == ";" and bool(_MODIFIER & set(words[:1]))


def normal_form(code: str, imports: bool = False, comments: bool = False, literals: bool = False) -> str:
    """The snippet printed evenly: tokens joined by one rule, a statement a line, blocks indented by four.

    Without `imports`, package and import lines go, without `comments` the comments, without `literals` each literal
    becomes its kind. __ERROR__ for what is no code, __EMPTY__ where nothing is left.
    """
    wrap, toks = parse_wrap(code)
    if toks is None:
        return ERROR
    lines, line, depth, paren, k = [], "", 0, 0, 0
    while k < len(toks):
        t = toks[k]
        k += 1
        if t.kind == "comment":
            if comments:
                if line.strip():
                    lines.append("    " * depth + line.strip())
                lines.append("    " * depth + re.sub(r"\s+", " ", t.text))
                line = ""
            continue
        if not imports and not line and not depth and t.text in ("import", "package"):
            while k < len(toks) and toks[k - 1].text != ";":
                k += 1
            continue
        text = t.text
        if not literals and t.kind in ("string", "char", "double", "long", "integer", "boolean"):
            text = f"__{t.kind}__"
        if t.text == "(":
            paren += 1
        elif t.text == ")":
            paren -= 1
        if t.text == "}" and not paren:
            if line.strip():
                lines.append("    " * depth + line.strip())
            depth, line = max(0, depth - 1), ""
            lines.append("    " * depth + "}")
            continue
        line = _append(line, text)
        if not paren and t.text in ("{", ";"):
            lines.append("    " * depth + line.strip())
            depth, line = depth + (t.text == "{"), ""
    if line.strip():
        lines.append("    " * depth + line.strip())
    out = "\n".join(lines).strip()
    return out if out else EMPTY


def _append(line: str, text: str) -> str:
    tight = text in (".", ",", ";", ")", "]", "(", "[", "++", "--", "::") or line.endswith((".", "(", "[", "!", "@", "::")) or not line
    if text == "(" and re.search(r"(?:\b(?:if|for|while|switch|catch|return|synchronized)|[-+*/=<>&|?:,])$", line):
        tight = False
    return line + text if tight else f"{line} {text}"


def sequence(code: str, imports: bool = False, comments: bool = True, literals: bool = False, calls: bool = True, unsolved: bool = False) -> list[str]:
    """Ordered entries of a snippet: _IM_ imports, _COM_ comments, _OC_ object creations, _VAR_ variable types with
    `literals`, _MC_ Type.method calls, _UMC_ calls of unknown owner with `unsolved`. [__ERROR__] or [__EMPTY__]."""
    _, toks = parse_wrap(code or "")
    if toks is None:
        return [ERROR]
    real = [t for t in toks if t.kind != "comment"]
    entries: list[tuple[int, int, str]] = []

    def add(at: int, name: str) -> None:
        entries.append((at, len(entries), name))

    known: set[str] = set()
    for i, t in enumerate(real):
        if t.text == "import" and t.kind == "name":
            j = i + 1
            while j < len(real) and real[j].text != ";":
                j += 1
            name = "".join(x.text for x in real[i + 1 : j] if x.text != "static").removesuffix(".*")
            known.add(name.rpartition(".")[2])
            if imports:
                add(t.at, f"_IM_{name}")
    if comments:
        for t in toks:
            if t.kind == "comment" and not t.text.startswith("/**"):
                # an entry is one line, and a comma would end it
                body = " ".join(re.sub(_LINE_STARS, "", re.sub(_COMMENT_MARKS, "", t.text)).replace(",", " ").split())
                if body and not body.startswith(_GENERATED):
                    add(t.at, f"_COM_{body}")
    types: dict[str, str] = {}
    for k, kind, variable in _declared(real):
        types[real[k].text] = kind
        if literals and variable:
            add(real[k].at, f"_VAR_{kind}")
    own = {real[i].text for i in range(1, len(real) - 1) if real[i].kind == "name" and real[i + 1].text == "(" and real[i - 1].kind == "name" and real[i - 1].text not in _NO_CALL | _WORD_BEFORE}
    for i, t in enumerate(real):
        if t.text == "new" and t.kind == "name":
            j = _type_end(real, i + 1)
            if j > i + 1 and j < len(real) and real[j].text == "(":
                add(t.at, f"_OC_{_join_type(real[i + 1 : j])}")
            elif j < len(real) - 1 and real[j].text == "<" and real[j + 1].text == ">":
                add(t.at, f"_OC_{_join_type(real[i + 1 : j])}<>")
        if not calls or t.kind != "name" or t.text in _NO_CALL or i + 1 >= len(real) or real[i + 1].text != "(":
            continue
        before = real[i - 1] if i else None
        if before and (before.text == "new" or (before.kind == "name" and before.text not in _NO_CALL) or before.text in (">", "]", "@")):
            continue  # a declaration, a constructor or an annotation
        if t.text in _SKIPPED_CALLS:
            continue
        owner, at = "", t.at
        if before and before.text == ".":
            first = i - 2
            while first >= 2 and real[first].kind == "name" and real[first - 1].text == "." and real[first - 2].kind == "name":
                first -= 2
            head, last = real[first], real[i - 2]
            at = head.at
            if last.kind == "name" and first == i - 2:
                owner = "this" if last.text == "this" else types.get(last.text, last.text if last.text[:1].isupper() else "")
            elif last.kind == "name":
                owner = last.text if last.text[:1].isupper() else ""
            elif last.kind == "string":
                owner = "String"
            at = _start_of(real, i)
        elif t.text in own:
            owner = ""
        if owner:
            add(at, f"_MC_{owner}.{t.text}")
        elif unsolved:
            add(at, f"_UMC_{t.text}")
    return [name for _, _, name in sorted(entries)] or [EMPTY]


def _start_of(toks: list[Tok], i: int) -> int:
    """Source position where the expression before a call begins."""
    k = i
    while k >= 2 and toks[k - 1].text == ".":
        k -= 2
        if toks[k].text in (")", "]"):
            depth = 0
            while k >= 0:
                depth += toks[k].text in (")", "]")
                depth -= toks[k].text in ("(", "[")
                if not depth:
                    break
                k -= 1
            if k and toks[k - 1].kind == "name" and toks[k - 1].text not in _NO_CALL:
                k -= 1
    if k and toks[k - 1].text == "new":
        k -= 1
    return toks[max(k, 0)].at


def sequence_tokens(code: str, unique: bool = False, **flags: bool) -> list[str]:
    """The sequence without its prefixes; [] for errors and empty code."""
    seq = sequence(code, **flags)
    if seq in ([ERROR], [EMPTY]):
        return []
    out = [re.sub(r"^_(?:IM|VAR|OC|MC|UMC|COM)_", "", s) for s in seq]
    return list(dict.fromkeys(out)) if unique else out


def lexed(code: str) -> list[str]:
    """Token values of the normal form, [] for errors."""
    form = normal_form(code)
    toks = None if form in (ERROR, EMPTY) else lex(form)
    return [t.text for t in toks or [] if t.kind != "comment"]


def _column(f, kind: str):
    def apply(c: Column) -> Column:
        def safe(x):
            try:
                return None if x is None else f(x)
            except RecursionError:
                return None

        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            return s.map(safe)

        return run(c)

    return apply


code_wrap = _column(lambda x: parse_wrap(x)[0], "int")
code_normalize = _column(normal_form, "string")
code_lex = _column(lexed, "array<string>")


def code_sequence(c: Column, **flags: bool) -> Column:
    return _column(lambda x: sequence(x, **flags), "array<string>")(c)


def code_sequence_tokens(c: Column, unique: bool = False, **flags: bool) -> Column:
    return _column(lambda x: sequence_tokens(x, unique, **flags), "array<string>")(c)
