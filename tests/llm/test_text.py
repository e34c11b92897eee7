import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.llm.markup import clean_markup, count_units, parse, render, select_content
from askloom.llm.mixing import mix
from askloom.llm.packing import pack, sum_of_squares
from askloom.llm.repetition import LIMITS, Ratios, repeated_words, repetition, run_codes
from askloom.llm.tokens import token_count

H, L, C, X = "heading", "list_item", "code_block", "formula"
UNITS = [
    ("<h2>A</h2><p>x</p><ul><li>a</li><li><b>b</b></li></ul><pre><code># no\n* no\n</code></pre><p>$a_1$ \\(b\\)</p>", (1, 2, 1, 2)),
    ("<p>I mean &lt;h2&gt; and &lt;li&gt; at $5 or $7 a month. <code>$x$</code></p>", (0, 0, 0, 0)),
    ("&lt;p&gt;one&lt;/p&gt; &lt;pre&gt;&lt;code&gt;List&amp;lt;A&amp;gt; x;&lt;/code&gt;&lt;/pre&gt;", (0, 0, 1, 0)),
    ("## H\n\ntext\n\n- a\n- b\n\n1. c\n2. d\n\n    code\n\n    more\n\n```java\n# x\n- y\n```\n\n$$x^2$$", (1, 4, 2, 1)),
    ("Title\n=====\n\nOther\n-----\n\n+ a\n+ b", (2, 2, 0, 0)),
    ("text\n\n~~~\n<li>\nleft open", (0, 0, 1, 0)),
    ("Use `<pre>` and `# x` here, 2 * 3 * 4, a == b", (0, 0, 0, 0)),
    ("== H ==\n\n* a\n*b\n\n# c\n#d\n\n<source lang=java>\n* x\n</source>\n\n<math>x</math> '''b'''", (1, 4, 1, 1)),
    ("\\section*{S}\n\n\\begin{itemize}\n\\item a\n\\item \\texttt{b}\n\\end{itemize}\n\n\\begin{verbatim}\n\\item no\n\\end{verbatim}\n\n\\[x\\] and $y$", (1, 2, 1, 2)),
    ("intro\n\n    out.println(\"<li>\" + x);\n\n- item", (0, 1, 1, 0)),
    ("#one\n#two", (0, 2, 0, 0)),
    ("<ul><li></li><li>a</li></ul><pre></pre>", (0, 1, 0, 0)),
    ("plain text", (0, 0, 0, 0)),
    ("", (0, 0, 0, 0)),
    (None, (0, 0, 0, 0)),
]


@pytest.mark.parametrize("text,want", UNITS)
def test_units(text, want):
    assert count_units(select_content(parse(text))) == want
    if text and "\n" in text:
        assert count_units(select_content(parse(text.replace("\n", "\r\n")))) == want


def test_clean_text_keeps_structure():
    text = "<h2>Top</h2><p>Some <b>bold</b> text &amp; more.</p><ul><li>one</li><li>two</li></ul><pre><code>x &lt; 1;\n</code></pre><p>is $a$ so</p><!-- c -->"
    assert render(select_content(parse(text))) == "## Top\n\nSome bold text & more.\n\n- one\n- two\n\n```\nx < 1;\n```\n\nis $a$ so"
    assert render(parse("See [the guide](http://x/y) and **this**.")) == "See the guide and this."
    assert render(parse("[[http://x/y|the guide]] is {{mono|f()}} ''i''")) == "the guide is f() i"


NAV = "<ul>" + "".join(f"<li><a href='/{i}'>Menu {i}</a></li>" for i in range(8)) + "</ul>"
POST = "<p>A sentence of the post, with <a href='x'>a link</a>, and more.</p>" * 5 + "<h2>Top</h2><ul><li>one</li><li>two <a href='y'>three</a></li></ul><p>$a$</p>"


@pytest.mark.parametrize("text", [NAV + POST, POST + NAV, NAV + POST + NAV, POST + "<nav>" + "<a href='z'>Menu</a> " * 9 + "</nav>", POST + "<p>" + "<a href='z'>Menu</a><br>" * 9 + "</p>"])
def test_navigation_goes_with_its_items(text):
    nodes = select_content(parse(text))
    assert count_units(nodes) == count_units(parse(POST)) == (1, 2, 0, 1)
    assert render(nodes).replace("\n", " ").count("Menu") == 0 and render(nodes).startswith("A sentence of the post, with a link, and more.")
    assert "## Top\n\n- one\n- two three" in render(nodes)


def test_selection_decides_counts(spark):
    df = spark.createDataFrame([(1, NAV + POST), (2, POST)], "k long, t string")
    assert {tuple(r) for r in clean_markup(df, "k", "t").select("id", "heading", "list_item").collect()} == {(1, 1, 2), (2, 1, 2)}


def test_scripts_are_no_text():
    assert render(parse("<p>a</p><script>if (x) { y(); }</script><style>p {}</style><p>b</p>")) == "a\n\nb"


def test_lone_links_and_short_items_stay():
    for text, units in (("<p>a</p><ul><li><a href='x'>b</a></li></ul><p>c</p>", (0, 1, 0, 0)), ("<p>" + "Long text, with marks. " * 60 + "</p><ol>" + "<li>x</li>" * 12 + "</ol>", (0, 12, 0, 0)), ("<a href='x'>b</a>", (0, 0, 0, 0))):
        assert count_units(select_content(parse(text))) == units and "b" in render(select_content(parse(text + "<p>b</p>")))


def test_clean_markup_rows(spark):
    rows = [(1, "<p>a</p>"), (2, None), (3, ""), (None, "- x\n- y"), (4, "word " * 200_000), (1, "<p>a</p>")]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("heading", F.lit(9))
    got = clean_markup(df, "k", "t").collect()
    assert len(got) == 6 and {(r["id"], r["list_item"]) for r in got} == {(1, 0), (2, 0), (3, 0), (None, 2), (4, 0)}
    assert [r["clean"] for r in got if r["id"] in (2, 3)] == ["", ""]
    assert clean_markup(df.limit(0), "k", "t").collect() == []


def brute_repeated(words, run=5):
    grams = [tuple(words[i : i + run]) for i in range(len(words) - run + 1)]
    marked = set()
    for i, g in enumerate(grams):
        if g in grams[:i]:
            marked |= set(range(i, i + run))
    return len(marked)


def test_repeated_words():
    rng = random.Random(3)
    for n in (0, 4, 5, 6, 30, 80):
        for _ in range(20):
            words = [rng.choice("ab") for _ in range(n)]
            assert repeated_words(words) == brute_repeated(words)
    assert repeated_words(["a"] * 6) == 5


def third_in_isolated_runs(n, rng):
    """Just a third of n words repeated in runs of five, none beside another: the least that compression can see."""
    m = -(-n // 15)
    fresh = [f"u{i}" for i in range(n - 5 * m)]
    half = max(min(5 * m, len(fresh)), len(fresh) // 2)
    starts = rng.sample(range(0, half - 4, max(1, (half - 4) // m)), m) if (half - 4) >= m else None
    rest, out = fresh[half:], fresh[:half]
    for k, s in enumerate(starts):
        out += fresh[s : s + 5] + rest[k * len(rest) // m : (k + 1) * len(rest) // m]
    return out


def test_bands_lose_no_text_with_a_third_repeated():
    rng, ratios = random.Random(2), Ratios()
    for n in [*range(60, 420, 9), 700, 1500, 3000, 20_000, 150_000]:
        words = third_in_isolated_runs(n, rng)
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = [number[w] for w in words]
        if 3 * repeated_words(ids) >= len(ids):
            assert ratios.of_codes(run_codes(np.array(ids))) < min(0.99, [x for start, x in LIMITS if start <= n][-1])
        assert n < 64 or ratios.of_codes(run_codes(np.arange(n))) >= 1.0


def test_repetition(spark):
    rng = random.Random(1)
    noise = " ".join(f"{rng.getrandbits(64):x}" for _ in range(4000))
    plain = " ".join(f"word{rng.randrange(300)}" for _ in range(2000))
    rows = [(1, "the same old phrase again. " * 50), (2, None), (3, ""), (4, noise), (5, noise + " " + noise), (6, "ä ö ü ß é " * 3), (7, "one two three"), (8, plain), (9, (noise + " ") * 5)]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("share", F.lit("c"))
    got = {r["id"]: r for r in repetition(df, "id", "t").collect()}
    assert got[1]["share"] > 0.9 and got[1]["band"] == "repetitive"
    assert got[2]["words"] == got[3]["words"] == 0 and got[2]["share"] == 0
    assert got[4]["share"] is None and got[4]["band"] == "ordinary" and got[5]["share"] == 0.5 and got[5]["band"] == "repetitive"
    assert got[6]["repeated"] == 10 and got[6]["band"] == "repetitive" and got[7]["repeated"] == 0
    assert got[8]["band"] == "ordinary" and got[8]["repeated"] is None and got[9]["share"] == 0.8
    every = {r["id"]: r for r in repetition(df, "id", "t", every=True).collect()}
    assert every[4]["share"] == 0 and 3 * every[8]["repeated"] < every[8]["words"]
    letters = " ".join("".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(9)) for _ in range(300))
    assert repetition(spark.createDataFrame([(1, letters)], "id long, t string"), "id", "t").first()["band"] == "incompressible"
    assert repetition(spark.createDataFrame([], "id long, t string"), "id", "t").collect() == []


def test_sum_of_squares_keeps_capacity():
    import numpy as np

    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 101, 3000)
    w = sum_of_squares(sizes, 100)
    fill = np.bincount(w, sizes)
    assert fill.max() <= 100 and (fill.sum() / (len(fill) * 100)) > 0.95


def test_pack(spark):
    rows = [(i, n) for i, n in enumerate([5, 3, 2, 0, None, 10, 23, 30, 1, -4])] + [(None, 3)]
    got = pack(spark.createDataFrame(rows, "k long, n int").withColumn("piece", F.lit("c")), "k", "n", {1: 10, 2: 100}).collect()
    for plan, cap in ((1, 10), (2, 100)):
        mine = [r for r in got if r["plan_id"] == plan]
        fill, total = {}, {}
        for r in mine:
            fill[r["window_id"]] = fill.get(r["window_id"], 0) + r["tokens"]
            total[r["id"]] = total.get(r["id"], 0) + r["tokens"]
        assert max(fill.values()) <= cap and total == {i: max(0, n or 0) for i, n in rows if i is not None}
        pieces = {i: sorted(r["piece"] for r in mine if r["id"] == i) for i in total}
        assert all(p == list(range(len(p))) for p in pieces.values())
        assert all(len(p) == max(1, -(-total[i] // cap)) for i, p in pieces.items())
    many = pack(spark.range(3000).selectExpr("id k", "id % 37 * id % 37 + 1 n"), "k", "n", {1: 100}, windows_per_shard=50)
    fill = many.groupBy("window_id").agg(F.sum("tokens").alias("f"), F.count("*").alias("c"))
    assert many.count() == 3000 and fill.agg(F.max("f")).first()[0] <= 100 and fill.agg(F.sum("f")).first()[0] > 0.95 * 100 * fill.count()
    assert pack(spark.createDataFrame([], "k long, n int"), "k", "n", {1: 10}).collect() == []
    assert pack(spark.range(2).selectExpr("id k", "id n"), "k", "n", {}).collect() == []


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, s, rng.randrange(1, 400)) for i, s in enumerate(["Big "] * 3000 + ["small"] * 60 + ["other"] * 50)] + [(9_000, None, 5), (9_001, "big", None), (9_002, "big", 0), (None, "big", 7)]
    df = spark.createDataFrame(rows, "k long, s string, n long").withColumn("copies", F.lit("c")).repartition(9)
    targets = {"big": (0.6, 1), "small": (0.3, 4), "absent": (0.1, 2)}
    used, report = mix(df, "k", "s", "n", targets, fan_in=2)
    used, report = used.collect(), {r["source"]: r for r in report.collect()}
    assert len({r["id"] for r in used}) == len(used) and {r["source"] for r in used} == {"big", "small"}
    assert all(1 <= r["copies"] <= targets[r["source"]][1] for r in used)
    assert report["absent"]["actual_share"] == 0
    assert abs(report["big"]["actual_share"] / report["small"]["actual_share"] - 2) < 0.02
    for s in ("big", "small"):
        assert abs(report[s]["tokens"] - report[s]["planned_tokens"]) <= 400
        assert report[s]["tokens"] == sum(r["tokens"] * r["copies"] for r in used if r["source"] == s)
    again = mix(df, "k", "s", "n", targets, total=10_000_000.0)[1].collect()
    assert {r["source"]: r["most_copies"] for r in again} == {"big": 1, "small": 4, "absent": 0}
    empty = mix(df.limit(0), "k", "s", "n", targets)
    assert empty[0].collect() == [] and all(r["actual_share"] == 0 for r in empty[1].collect())


def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("",), ("<|endoftext|>",)], "t string")
    assert [r[0] for r in df.select(token_count(F.col("t"))).collect()][:3] == [2, 0, 0]
    assert df.select(token_count(F.col("t"))).collect()[3][0] > 1
