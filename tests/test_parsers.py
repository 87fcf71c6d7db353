import pytest

from graphloom.functions import parsers


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", ""),
        ("a//b\nc", "a   \nc"),
        ("a/*x/*y*/z\n*/b", "a         \n  b"),
        ('f("a\\"b//", \'"\');', "f(        ,    );"),
        ("/* open\nmain(", "       \n     "),
        ('"open\\', "      "),
        ("a/b*c", "a/b*c"),
    ],
)
def test_strip_comments(text, want):
    assert parsers.strip_comments(text) == want
    assert len(parsers.strip_comments(text)) == len(text)


def test_has_main():
    assert parsers.has_main("int\nmain (void) {}")
    assert not parsers.has_main('// main()\n/* main( */ char *s = "main(";')
    assert not parsers.has_main("domain()")


NINJA = """include rules.ninja
top = 1
rule cc
  command = cc $flags ${top}$none -o $out -c $in
  flags = -O0
# Object build statements for EXECUTABLE target my app
build a.o | a.d: cc a.c b.c | a.h || dir gen
  flags = -O2 $mine
  mine = -g
build b.o: cc b.c
build all: phony
"""


def test_ninja():
    parsed = parsers.parse_ninja(NINJA)
    assert parsed["includes"] == ["rules.ninja"] and parsed["vars"] == {"top": "1"} and parsed["target_types"] == {"my app": "EXECUTABLE"}
    first, second, last = parsers.commands(NINJA)
    assert first == {"outputs": ["a.o"], "implicit_outputs": ["a.d"], "rule": "cc", "inputs": ["a.c", "b.c"], "implicit_inputs": ["a.h"], "order_only": ["dir", "gen"], "command": "cc -O2 -g 1 -o a.o -c a.c b.c"}
    assert second["command"] == "cc -O0 1 -o b.o -c b.c"
    assert (last["rule"], last["inputs"], last["command"]) == ("phony", [], "")
    assert parsers.commands("") == []
    with pytest.raises(ValueError):
        parsers.commands("rule r\n  command = $x\nbuild o: r i\n  x = $x")


def test_ctest():
    text = 'add_test([=[a ]] b]=] "/x/y \\"z\\"" one)\nADD_TEST (bare cmd)\nadd_test()\nset(x y)\nadd_test(open [[rest'
    assert parsers.parse_ctest(text) == [{"name": "a ]] b", "command": ['/x/y "z"', "one"]}, {"name": "bare", "command": ["cmd"]}, {"name": "open", "command": ["rest"]}]


def test_module():
    text = """/** One line. */

export class A {}
/**
 * Adds.
 * @param {{x: number}} a the left
 * @returns {number} sum
 * @category Math
 * @since 1
 */
export function add(a, b) {
/** lost */
let x;
export const c = 1;
/** hidden */
export const __d = 1;
"""
    a, add, c = parsers.parse_module(text)
    assert (a["kind"], a["doc"]["summary"]) == ("class", "One line.")
    assert add["params"] == "a, b"
    assert add["doc"] == {"summary": "Adds.", "params": [{"type": "{x: number}", "name": "a", "description": "the left"}], "fields": [], "returns": {"type": "number", "description": "sum"}, "category": "Math"}
    assert (c["name"], c["doc"]) == ("c", None)


def test_columns_take_nulls_and_long_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "/*" * 20_000 + "main()"), (4, NINJA)], "id int, text string")
    out = df.select("id", parsers.has_main_of("text").alias("main"), parsers.commands_of("text").alias("edges"), parsers.ctest_of("text").alias("tests"), parsers.module_of("text").alias("exports")).orderBy("id").collect()
    assert [r["main"] for r in out] == [None, False, False, False]
    assert [None if r["edges"] is None else len(r["edges"]) for r in out] == [None, 0, 0, 3]
    assert out[0]["tests"] is None and out[1]["exports"] == []


def test_build_targets(spark):
    files = spark.createDataFrame([("a/x.c", "int main() {}"), ("a/y.c", None), ("b/z.c", "// main()"), ("top.c", "")], "path string, text string")
    assert {tuple(r)[:2] for r in parsers.build_targets(files).collect()} == {("a", "binary"), ("b", "library"), ("", "library")}
