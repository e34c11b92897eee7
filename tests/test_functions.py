from pyspark.sql import functions as F

from askloom.functions import code as C
from askloom.functions import ner as N
from askloom.functions import text as X
from askloom.functions import tokens as T
from askloom.functions.html import read_html


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_cleaning_rules(spark):
    assert one(spark, X.remove_stack_traces, "x at com.a.B.run(Bee.java:12) y") == "x y"
    assert one(spark, X.remove_binary_strings, "a 0101.1100.0011.1111 b") == "a   b"
    assert one(spark, X.remove_long_packages, "a ab.cd.ef.gh.ij.kl b") == "a b"
    assert one(spark, X.normalize_text, "C# c++ #tag a\\b") == "C# c++ tag a b"
    assert one(spark, X.clean_corpus, None) is None
    assert one(spark, X.emoticon_polarity, "ok :-) but :(") == "BOTH_HS"
    assert one(spark, X.split_tags, "<java>") == ["<unk>"]
    assert one(spark, X.clean_entity, "Tool##Node.js(v8)'s") == "node.js"
    block = one(spark, lambda c: X.parse_snippet(X.snippet_block(F.lit(5), F.lit(-2), F.array(c, F.lit("y")), "u/")), "x")
    assert (block.anslink, block.score, block.snippet) == ("u/5", -2, "x\n\ny")


def test_quality_edges(spark):
    assert one(spark, X.line_quality, "no marks") == 2.0
    assert one(spark, X.keeps_quality, ";" * 1001) is False
    assert one(spark, X.keeps_quality, "") is True


def test_html():
    assert read_html("<p>a &lt;b&gt; <code> x </code><code></code>") == ("a <b>  x ", ["x"])
    assert read_html("<pre>p</pre>q", drop="pre")[0] == "q"
    assert read_html(None) == ("", [])
    assert read_html("a<pre>new A();</pre>b", "pre", replace=lambda c: ", ".join(C.sequence(c)))[0] == "a _OC_A b"


def test_code():
    wraps = {"int x = 5;": 2, "class A { void f() { } }": 0, "public int f() { return 1; }": 1, "broken ( text": -1, "not code at all": -1, "": 0, "import a.B;": 0, "foo()": -1, "@Override\npublic String f() { return x; }": 1}
    assert {k: C.parse_wrap(k)[0] for k in wraps} == wraps
    assert C.sequence('List<String> a = new ArrayList<>(); a.add("x"); this.go(); b.c();', literals=True, unsolved=True) == ["_VAR_List<String>", "_OC_ArrayList<>", "_MC_List<String>.add", "_MC_this.go", "_UMC_c"]
    assert C.sequence("// only, this\n") == ["_COM_only this"]
    assert C.sequence("x = ;;(") == [C.ERROR]
    assert C.normal_form("// a") == C.EMPTY
    assert C.normal_form('f("x", 1L, 2.0, \'c\', true, null);') == "f(__string__, __long__, __double__, __char__, __boolean__, null);"
    assert C.sequence_tokens("new A(); new A();", unique=True) == ["A"]
    assert C.lexed("int  a=1;") == ["int", "a", "=", "__integer__", ";"]


def test_tokens():
    assert T.norm_line("I've C#'s one.two() getSize(), isn't 12:30 100% #tag") == "i have c# is one.two() getsize() is not 100% #tag"
    assert T.norm_line(None) == "" and T.norm_line("-- 12 ;") == ""
    assert T.lemma_line("classes running stopped copies") == "class run stop copy"
    text = "Hi :) see a.b() at 12:30, x=1!"
    assert all(text[i : i + len(t)] == t for t, i in T.social_tokens(text))
    assert "a.b()" in [t for t, _ in T.social_tokens(text)]
    assert T.split_sentences("I call a.b() now. Then e.g. this. Done!\n\nNext") == ["I call a.b() now.", "Then e.g. this.", "Done!", "Next"]


def test_merge_entities(spark):
    rows = [[("a", "B-P"), ("x", "O"), ("b", "I-P"), ("c", "I-Q"), ("d", "B-Q")], []]
    df = spark.createDataFrame([(r,) for r in rows], "t array<struct<token:string,label:string>>")
    got = [r[0] for r in df.select(N.merge_entities(F.col("t"))).collect()]
    assert got == [["P##a b", "Q##c", "Q##d"], []]


def test_phrases(spark):
    df = spark.createDataFrame([(["new", "york", "city", "new"],)], "t array<string>")
    assert df.select(T.merge_phrases(F.col("t"), F.array(F.lit("new york")))).first()[0] == ["new_york", "city", "new"]


def test_tagger():
    data = [([["w=A"], ["w=b"]], ["B-X", "O"]), ([["w=b"], ["w=A"]], ["O", "B-X"])] * 3
    model = N.LinearChain(["O", "B-X"]).train(data)
    assert all(model.tag(f) == y for f, y in data) and model.tag([]) == []
    assert len(N.read_templates()) == 83 and N.read_templates("w -1,0 1") == [(("w", -1), ("w", 0)), (("w", 1),)]
