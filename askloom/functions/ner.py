"""Token features and entity sequences. Token features are JVM expressions, context features index the token array."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Token classes in the order they are tried. A class is a set of character kinds: U upper, L lower,
# D digit , or . and S any other.
CLASSES = (
    ("AllUpper", "U"),
    ("AllDigit", "D"),
    ("AllSymbol", "S"),
    ("AllUpperDigit", "UD"),
    ("AllUpperSymbol", "US"),
    ("AllDigitSymbol", "DS"),
    ("AllUpperDigitSymbol", "UDS"),
    ("InitUpper", ""),
    ("AllLetter", "UL"),
    ("AllAlnum", "ULD"),
)
_KIND = {"U": r"\p{Lu}", "L": r"\p{Ll}", "D": r"\p{Nd},."}
# What an API call and a camel-case name look like.
API = r"^(?:[a-zA-Z_$][a-zA-Z0-9_$]*\(\)$|([a-zA-Z_$][a-zA-Z0-9_$]*\.)+[a-zA-Z_$][a-zA-Z0-9_$]*(\(\))?)"
CAMEL = r"^([a-z]+[A-Z]+\w+)+"


def class_pattern(kinds: str) -> str:
    """A regular expression of the tokens made of these kinds of characters."""
    if "S" not in kinds:
        return "^[" + "".join(_KIND[k] for k in kinds) + "]*$"
    return "^[^" + "".join(_KIND[k] for k in "ULD" if k not in kinds) + "]*$"


def token_type(c: Column) -> Column:
    out = F.lit("NO")
    for name, kinds in reversed(CLASSES):
        hit = c.rlike(r"^\p{Lu}") if name == "InitUpper" else c.rlike(class_pattern(kinds))
        out = F.when(hit, name).otherwise(out)
    return out


def token_shape(c: Column) -> Column:
    """Characters as U L D . - ( ); everything else is -."""
    for pattern, to in ((r"[^\p{Lu}\p{Ll}\p{Nd}._(){}\[\]<>]", "-"), (r"\p{Lu}", "\u0001"), (r"\p{Ll}", "\u0002"), (r"\p{Nd}", "\u0003"), (r"[._]", "."), (r"[({\[<]", "("), (r"[)}\]>]", ")")):
        c = F.regexp_replace(c, pattern, to)
    return F.translate(c, "\u0001\u0002\u0003", "ULD")


def flag(c: Column) -> Column:
    return F.when(c, "T").otherwise("F")


def token_flags(c: Column, strict_compat: bool = False) -> dict[str, Column]:
    """Flags T or F. The camel-case flag follows its intent; `strict_compat` gives the constant F."""
    return {
        "brac": flag(c.endswith("()")),
        "dot": flag(c.contains(".")),
        "uscr": flag(c.contains("_")),
        "init_cap": flag(c.rlike(r"^\p{Lu}")),
        "ccase": F.lit("F") if strict_compat else flag(c.rlike(CAMEL)),
        "api_ptrn": flag(c.rlike(API)),
    }


def token_affixes(c: Column) -> dict[str, Column]:
    return {f"p{k}": F.substring(c, 1, k) for k in range(1, 5)} | {f"s{k}": F.right(c, F.lit(k)) for k in range(1, 5)}


def gazetteer_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\(\)$", ""))


def context_template(order: Sequence[tuple[tuple[str, int], ...]], array: Column) -> Column:
    """Features of every token of array<struct>: each template of (field, offset) pairs gives `f[o]|f[o]=v|v`, and
    nothing where an offset leaves the sentence; first and last token are marked."""

    def one(i: Column, template: tuple[tuple[str, int], ...]) -> Column:
        name = "|".join(f"{f}[{o}]" for f, o in template)
        inside = F.lit(True)
        for _, o in template:
            inside = inside & (i + o >= 0) & (i + o < F.size(array))
        values = [F.get(array, i + o)[f].cast("string") for f, o in template]
        return F.when(inside, F.concat(F.lit(name + "="), F.concat_ws("|", *values)))

    def features(x: Column, i: Column) -> Column:
        marks = [F.when(i == 0, F.lit("__BOS__")), F.when(i == F.size(array) - 1, F.lit("__EOS__"))]
        return F.filter(F.array(*[one(i, t) for t in order], *marks), lambda v: v.isNotNull())

    return F.transform(array, features)


# The templates of the tagger in their order, a field and the offsets it is read at; a,b is one template
# of two places.
TEMPLATES = """
w 0
wl 0
dot 0
brac 0
uscr 0
init_cap 0
ccase 0
api_ptrn 0
p1 0
p2 0
p3 0
p4 0
s1 0
s2 0
s3 0
s4 0
is_api 0
is_plat 0
is_pl 0
is_org 0
is_stan 0
is_fram 0
w -1,0 0,1
wl -1,0 0,1
brown -1 0 1 -1,0 0,1 -1,1
brown-p2 -1 0 1
brown-p4 -1 0 1
brown-p6 -1 0 1
brown-p8 -1 0 1
brown-p10 -1 0 1
brown-p12 -1 0 1
brown-p14 -1 0 1
ce500 -1 0 1 -1,0 0,1 -1,1
ce1000 -1 0 1 -1,0 0,1 -1,1
ce1500 -1 0 1 -1,0 0,1 -1,1
ce2000 -1 0 1 -1,0 0,1 -1,1
ce3000 -1 0 1 -1,0 0,1 -1,1
"""
LISTS = ("is_api", "is_plat", "is_pl", "is_org", "is_stan", "is_fram")
PREFIXES = (2, 4, 6, 8, 10, 12, 14)
CLUSTERS = ("ce500", "ce1000", "ce1500", "ce2000", "ce3000")


def read_templates(table: str = TEMPLATES) -> list[tuple[tuple[str, int], ...]]:
    """A line `field places..` for each entry; a place is offsets joined by commas."""
    rows = (line.split() for line in table.splitlines() if line.strip())
    return [tuple((name, int(o)) for o in place.split(",")) for name, *places in rows for place in places]


def token_fields(token: Column, lists: Column, path: Column, clusters: dict[str, Column]) -> dict[str, Column]:
    """Every field the templates read: `lists` names the lists that hold the token, `path` is its Brown path, `clusters`
    are its cluster ids; nulls mean none."""
    out = {"w": token, "wl": F.lower(token)} | token_flags(token) | token_affixes(token)
    out |= {k: flag(F.coalesce(F.array_contains(lists, k), F.lit(False))) for k in LISTS}
    out["brown"] = F.coalesce(path, F.lit(""))
    out |= {f"brown-p{n}": F.substring(out["brown"], 1, n) for n in PREFIXES}
    return out | {k: F.coalesce(c.cast("string"), F.lit("")) for k, c in clusters.items()}


def merge_entities(tokens: Column) -> Column:
    """array<struct<token, label>> to `Type##text`: an I- token joins the entity before it where the types agree; the
    type in force outlives an O."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("prev"))

    def step(s: Column, t: Column) -> Column:
        kind = F.substring(t["label"], 3, 1000)
        n = F.size(s["out"])
        joined = F.concat(F.slice(s["out"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(s["out"], F.when(n > 0, -1).otherwise(1)), F.lit(" "), t["token"])))
        added = F.concat(s["out"], F.array(F.concat(kind, F.lit("##"), t["token"])))
        inside = t["label"].startswith("I-") & (s["prev"] == kind) & (n > 0)
        return F.when(t["label"] == "O", s).when(inside, F.struct(joined.alias("out"), s["prev"].alias("prev"))).otherwise(F.struct(added.alias("out"), kind.alias("prev")))

    return F.aggregate(tokens, start, step, lambda s: s["out"])


class LinearChain:
    """A linear-chain tagger: feature weights per label and transition weights, decoded by Viterbi in numpy."""

    def __init__(self, labels: Sequence[str], weights: Mapping[str, np.ndarray] | None = None, moves: np.ndarray | None = None):
        self.labels = list(labels)
        self.weights: dict[str, np.ndarray] = dict(weights or {})
        self.moves = np.zeros((len(self.labels), len(self.labels))) if moves is None else moves

    def emit(self, features: Sequence[Sequence[str]]) -> np.ndarray:
        out = np.zeros((len(features), len(self.labels)))
        for i, fs in enumerate(features):
            for f in fs:
                w = self.weights.get(f)
                if w is not None:
                    out[i] += w
        return out

    def tag(self, features: Sequence[Sequence[str]]) -> list[str]:
        if not len(features):
            return []
        e = self.emit(features)
        best, back = e[0], []
        for row in e[1:]:
            total = best[:, None] + self.moves
            back.append(total.argmax(0))
            best = total.max(0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return [self.labels[k] for k in reversed(path)]

    def train(self, sentences: Sequence[tuple[Sequence[Sequence[str]], Sequence[str]]], rounds: int = 5) -> LinearChain:
        """Averaged structured perceptron over a bounded labelled sample held by the caller."""
        at = {x: k for k, x in enumerate(self.labels)}
        sums: dict[str, np.ndarray] = {}
        moved, steps = np.zeros_like(self.moves), 0
        for _ in range(rounds):
            for features, gold in sentences:
                guess = self.tag(features)
                steps += 1
                if guess != list(gold):
                    for fs, g, h in zip(features, gold, guess):
                        if g == h:
                            continue
                        for f in fs:
                            w = self.weights.setdefault(f, np.zeros(len(self.labels)))
                            w[at[g]] += 1
                            w[at[h]] -= 1
                            s = sums.setdefault(f, np.zeros(len(self.labels)))
                            s[at[g]] += steps
                            s[at[h]] -= steps
                    for seq, sign in ((gold, 1), (guess, -1)):
                        for x, y in zip(seq, seq[1:]):
                            self.moves[at[x], at[y]] += sign
                            moved[at[x], at[y]] += sign * steps
        if steps:
            self.weights = {f: w - sums.get(f, 0) / (steps + 1) for f, w in self.weights.items()}
            self.moves = self.moves - moved / (steps + 1)
        return self
