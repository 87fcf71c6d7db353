import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.functions import syntax

SOURCE = '{"name": "imp", "ok": true}'


def texts(source, query):
    return [[c["text"] for c in m["captures"]] for m in syntax.matches(source, syntax.compile_query(query))]


def test_captures_in_document_order():
    assert texts(SOURCE, "(string (string_content) @key)") == [["name"], ["imp"], ["ok"]]
    assert texts(SOURCE, "(pair key: (string) @k value: (_) @v)") == [['"name"', '"imp"'], ['"ok"', "true"]]
    first = syntax.matches('[1,\n "é", "x"]', syntax.compile_query("(string) @s"))[1]["captures"][0]
    assert (first["start_byte"], first["end_byte"], first["start"]) == (11, 14, {"row": 1, "column": 7})
    assert texts("[1, 2, 3]", "(array (number) @a (number) @b)") == [["1", "2"], ["1", "3"], ["2", "3"]]


def test_sexp():
    assert syntax.sexp(syntax.parse(b'{"a\\n": [null]}')) == "(document (object (pair key: (string (string_content) (escape_sequence)) value: (array (null)))))"
    assert syntax.sexp(syntax.parse(b" ")) == "(document)"


@pytest.mark.parametrize("bad", ["{", "[1,]", "{1: 2}", '{"a" 1}', "1 2", "]", "nul", '{"a": 1,}', '"open'])
def test_bad_texts(bad):
    with pytest.raises(syntax.SyntaxProblem):
        syntax.parse(bad.encode())


@pytest.mark.parametrize("bad", ["(", "(a))", "a", "@x", "()", "(a key:)", "(a ?)"])
def test_bad_queries(bad):
    with pytest.raises(syntax.SyntaxProblem):
        syntax.compile_query(bad)


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12)


@settings(deadline=None)
@given(JSON)
def test_all_json_parses(value):
    tree = syntax.parse(json.dumps(value).encode())
    assert len(tree.children) == 1
    assert all(0 <= n.start < n.end for n in syntax.walk(tree.children[0]))


def test_depth_has_no_limit():
    assert sum(1 for _ in syntax.walk(syntax.parse(b"[" * 50_000 + b"]" * 50_000))) == 50_001


def test_columns(spark):
    df = spark.createDataFrame([(1, SOURCE), (2, None), (3, "{"), (4, "")], "id int, text string")
    out = df.select(syntax.query_of(df["text"], "(true) @t").alias("m")).collect()
    assert [None if r["m"] is None else len(r["m"]) for r in out] == [1, None, None, 0]
