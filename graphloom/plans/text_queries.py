"""Registered queries of the text parsers, over texts composed from the tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import parsers, syntax
from graphloom.plans.build_queries import query


def text(*parts):
    """Columns by name and literals (written with ``=`` in front) in one text."""
    return F.concat(*(F.lit(p[1:]) if p.startswith("=") else F.col(p).cast("string") for p in parts))


@query("SELECT doc_id, repeat(' ', length('/* a /* nested */ b ' || source || '*/')) || 'int ' || lang || ' =   ' || repeat(' ', length(source)) || ';' || repeat(' ', length('// ' || doc_id || ' ')) || chr(10) || 'x' AS blanked FROM {documents}", "documents")
def strip_comments(documents):
    code = text("=/* a /* nested */ b ", "source", "=*/int ", "lang", '= = "', "source", '=";', "=// ", "doc_id", "= \nx")
    return documents.select("doc_id", parsers.strip_comments_of(code).alias("blanked"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'o' || l_orderkey || '.o' AS output, 'p' || l_partkey || '.c' AS input, 'h' || l_suppkey || '.h' AS implicit_input, 'cc -O' || l_linenumber || ' -o o' || l_orderkey || '.o p' || l_partkey || '.c' AS command FROM {lineitem}", "lineitem")
def ninja_parse(lineitem):
    build = text("=rule cc\n  command = $compiler $flags -o $out $in\n  flags = -g\ncompiler = cc\nbuild o", "l_orderkey", "=.o: cc p", "l_partkey", "=.c | h", "l_suppkey", "=.h || dir\n  flags = -O$level\n  level = ", "l_linenumber")
    edge = F.explode(parsers.commands_of(build)).alias("e")
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", edge).select("l_orderkey", "l_linenumber", "l_partkey", F.element_at("e.outputs", 1).alias("output"), F.element_at("e.inputs", 1).alias("input"), F.element_at("e.implicit_inputs", 1).alias("implicit_input"), "e.command")


@query("SELECT s_suppkey, 'test ' || s_suppkey AS name, '/bin/n' || s_nationkey || ' \"' || s_name || '\"' AS command FROM {supplier}", "supplier")
def ctest_parse(supplier):
    # the name in long brackets, then a quoted path and a quoted word with escapes
    tests = parsers.ctest_of(text("=add_test([==[test ", "s_suppkey", "=]==] \"/bin/n", "s_nationkey", '="  "\\"', "s_name", '=\\"")\n'))
    return supplier.select("s_suppkey", F.explode(tests).alias("t")).select("s_suppkey", "t.name", F.array_join("t.command", " ").alias("command"))


@query("SELECT 'n' || s_nationkey AS program, string_agg('t' || s_suppkey, ',' ORDER BY 't' || s_suppkey) AS tests FROM {supplier} GROUP BY s_nationkey", "supplier")
def ctest_join(supplier):
    tests = supplier.select(F.explode(parsers.ctest_of(text("=add_test(t", "s_suppkey", "= /bin/n", "s_nationkey", "=)"))).alias("t"))
    program = F.element_at(F.split(F.element_at("t.command", 1), "/"), -1).alias("program")
    return tests.groupBy(program).agg(F.array_join(F.array_sort(F.collect_list("t.name")), ",").alias("tests"))


@query("SELECT p_partkey, 'f' || p_partkey AS name, p_type AS summary, 'size' AS param, p_brand AS category FROM {part}", "part")
def doc_extract(part):
    module = text("=/** lost */\nlet x;\n/**\n * ", "p_type", "=\n * @param {number} size of it\n * @category ", "p_brand", "=\n */\n\nexport function f", "p_partkey", "=(size) {\n}\nexport const __hidden = 1;\n")
    found = part.select("p_partkey", F.explode(parsers.module_of(module)).alias("e"))
    return found.select("p_partkey", "e.name", "e.doc.summary", F.col("e.doc.params")[0]["name"].alias("param"), F.split_part("e.doc.category", F.lit(" "), F.lit(1)).alias("category"))


@query("SELECT lang || '/' || source AS folder, CASE WHEN bool_or(doc_id % 97 = 0) THEN 'binary' ELSE 'library' END AS kind, count(DISTINCT doc_id) AS n_sources FROM {documents} GROUP BY ALL", "documents")
def gen_build_c(documents):
    # a third of the sources only mention an entry point, in a comment or a string
    code = F.when(F.expr("doc_id % 97 = 0"), "int main(void) {}").when(F.expr("doc_id % 3 = 0"), '/* main() */ char *s = "main(";').otherwise("int f() {}")
    files = documents.select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), code.alias("text"))
    return parsers.build_targets(files).select("folder", "kind", F.size("sources").cast("long").alias("n_sources"))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM {events}", "events")
def ts_query(events):
    found = events.select("event_id", F.explode(syntax.query_of(F.col("props"), "(pair key: (string (string_content) @key) value: (number) @value)")).alias("m"))
    return found.select("event_id", F.col("m.captures")[0]["text"].alias("key"), F.col("m.captures")[1]["text"].alias("value"))
