import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from askloom.operators.packed import ENTITIES, QUESTION_FIELDS, SNIPPETS, TAGS, split_packed, tokenize

CASES = [
    (TAGS, "<java><>random><c++>", ["java", "random", "c++"]),
    (TAGS, "&lt;java&gt;&lt;\"front end\"&gt;", ["java", "front end"]),
    (TAGS, '["a", "b\\"c"]', ["a", 'b"c']),
    (TAGS, "|java|'tcp|udp'|", ["java", "tcp|udp"]),
    (TAGS, "java,, io;net;", ["java", "io", "net"]),
    (TAGS, " <> ", []),
    (TAGS, "a a", ["a", "a"]),
    (TAGS, '"open', ['"open']),
    (ENTITIES, "JVM's heap<_ent_>Java", ["JVM's heap", "Java"]),
    (ENTITIES, '"say ""hi"", World"<_ENT_/> C#', ['say "hi", World', "C#"]),
    (ENTITIES, '["Java SE", "the ""main"" thread"]', ["Java SE", 'the "main" thread']),
    (ENTITIES, "VM (64-bit)||R&D Server", ["VM (64-bit)", "R&D Server"]),
    (SNIPPETS, "Post: u/1\n##Score \nf();<_code_>\"m = \"\"a<_code_>b\"\";\nx\"\n<_POST_>Post: u\n##Score -4\n\"a\".b();[_code_]c", ["f();", 'm = "a<_code_>b";\nx', '"a".b();', "c"]),
    (SNIPPETS, "Post: u\n##Score 2", []),
]


@pytest.mark.parametrize("grammar,text,want", CASES)
def test_tokenize(grammar, text, want):
    assert tokenize(text, grammar) == want


@given(st.lists(st.text("ab ,|<>\"'", min_size=1, max_size=6).map(lambda s: s.strip() or "x"), max_size=6))
@settings(max_examples=200, deadline=None)
def test_round_trip(values):
    packed = "<_ent_>".join('"' + v.replace('"', '""') + '"' for v in values)
    assert tokenize(packed, ENTITIES) == values


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_ends(text):
    for g in QUESTION_FIELDS.values():
        assert all(tokenize(text, g)) or tokenize(text, g) == []


def test_split_packed(spark):
    rows = [(1, "<a><b>", None, ""), (2, None, "x,y", "z" * 300_000), (3, "a", "a", "a")]
    df = spark.createDataFrame(rows, "Id long, Tags string, Entities string, Snippets string").selectExpr("*", "1 as pos", "2 as item")
    got = sorted(map(tuple, split_packed(df, "Id", QUESTION_FIELDS).collect()))
    assert [r[:3] for r in got] == [("Entities", 2, 1), ("Entities", 2, 2), ("Entities", 3, 1), ("Snippets", 2, 1), ("Snippets", 3, 1), ("Tags", 1, 1), ("Tags", 1, 2), ("Tags", 3, 1)]
    assert split_packed(df.limit(0), "Id", QUESTION_FIELDS).collect() == []
