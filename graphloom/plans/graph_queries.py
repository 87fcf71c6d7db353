"""Registered queries of staleness by recorded inputs, walks, packages, schemas and digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from graphloom.operators import changes, graphs, logs, packages, schemas, staleness, store, trees
from graphloom.plans import closure
from graphloom.plans.build_queries import query

_OLD = "path LIKE '%50' OR path LIKE '%7'"


def _changed(tree):
    return tree.where(_OLD).select("path")


def _place(tree, i):
    return F.split_part("path", F.lit("/"), F.lit(i))


def _spec(kind, spec):
    return F.lit(kind).alias("kind"), spec.alias("spec"), F.lit(None).cast("string").alias("digest")


@query(
    f"""WITH c AS (SELECT path FROM {{tree_before}} WHERE {_OLD})
    SELECT DISTINCT 'file:' || path AS key FROM c UNION SELECT DISTINCT 'dir:' || regexp_replace(path, '/[^/]*$', '') FROM c
    UNION SELECT DISTINCT 'set:' || split_part(path, '/', 1) FROM c WHERE NOT ends_with(path, '07') UNION SELECT DISTINCT 'deep:' || split_part(path, '/', 2) FROM c
    UNION SELECT 'config:' || b FROM (SELECT DISTINCT p_brand AS b FROM {{part}} WHERE p_brand IN (SELECT p_brand FROM {{part}} GROUP BY p_brand HAVING max(p_size) <> min(p_size)))
    UNION SELECT 'config:none'""",
    "tree_before", "part",
)
def stale_input(tree, part):
    path, folder = F.col("path"), F.regexp_replace("path", "/[^/]*$", "")
    files = tree.select(F.concat(F.lit("file:"), path).alias("key"), *_spec("read_file", F.concat(F.lit('"'), path, F.lit('"'))))
    folders = tree.select(folder.alias("f")).distinct().select(F.concat(F.lit("dir:"), "f").alias("key"), *_spec("run_input", F.concat(F.lit('{"kind":"directory","path":"'), "f", F.lit('/"}'))))
    langs = tree.select(_place(tree, 1).alias("f")).distinct().select(F.concat(F.lit("set:"), "f").alias("key"), *_spec("fileset", F.concat(F.lit('{"root":"'), "f", F.lit('","include":["*/*0","*/*7"],"exclude":["**/*07"]}'))))
    deep = tree.select(_place(tree, 2).alias("f")).distinct().select(F.concat(F.lit("deep:"), "f").alias("key"), *_spec("fileset", F.concat(F.lit('{"paths":[],"union":[{"root":".","include":["**/'), "f", F.lit('/*"]},{"paths":["nowhere"]}]}'))))
    other = tree.select(F.concat(F.lit("other:"), path).alias("key"), *_spec("unheard-of", F.concat(F.lit('"'), path, F.lit('"'))))
    sizes = part.groupBy("p_brand").agg(F.min("p_size").alias("old"), F.max("p_size").alias("new"))
    recorded = staleness.namespace_digest(sizes.select(F.col("p_brand").alias("key"), F.array("p_brand").alias("namespaces")), sizes.select(F.col("p_brand").alias("namespace"), F.col("old").cast("string").alias("value")))
    config = recorded.select(F.concat(F.lit("config:"), "key").alias("key"), F.lit("config_namespaces").alias("kind"), F.concat(F.lit('["'), "key", F.lit('"]')).alias("spec"), "digest")
    none = tree.sparkSession.range(1).select(F.lit("config:none").alias("key"), *_spec("config_namespaces", F.lit("[]")))
    specs = reduce(lambda a, b: a.unionByName(b), [files, folders, langs, deep, other, config, none])
    return staleness.stale_inputs(specs, _changed(tree), sizes.select(F.col("p_brand").alias("namespace"), F.col("new").cast("string").alias("value")))


@query("SELECT p_brand AS key FROM {part} GROUP BY p_brand HAVING max(p_size) FILTER (WHERE p_partkey % 2 = 0) IS DISTINCT FROM max(p_size)", "part")
def stale_config(part):
    value = lambda rows: rows.groupBy(F.col("p_brand").alias("namespace")).agg(F.max("p_size").cast("string").alias("value"))
    keys = part.select(F.col("p_brand").alias("key")).distinct().withColumn("namespaces", F.array("key"))
    recorded = staleness.namespace_digest(keys, value(part.where("p_partkey % 2 = 0")))
    return staleness.stale_config(recorded.select("key", F.to_json(F.array("key")).alias("spec"), "digest"), value(part))


@query("SELECT DISTINCT path FROM {tree_before} WHERE (path LIKE '%50' OR path LIKE '%7') AND starts_with(path, 'en/') AND NOT contains(path, '/src1/')", "tree_before")
def fs_files_leaf(tree):
    one = tree.sparkSession.range(1).select(F.lit("k").alias("key"), F.lit("en").alias("root"), F.array(F.lit("**")).alias("include"), F.array(F.lit("src1/*")).alias("exclude"), F.array().cast("array<string>").alias("paths"))
    return staleness.touched_filesets(one, _changed(tree)).select("path")


@query("SELECT event_id AS key FROM {events} WHERE event_type = 'click' AND event_id % 3 = 1 ORDER BY event_id", "events")
def memo_by_fn(table):
    line = F.to_json(F.struct((F.col("event_id") % 3).cast("int").alias("version"), F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("fn_id")))
    # every seventh line is broken, and those of other versions are skipped
    found = staleness.records_of(staleness.trace_records(table.select(line.alias("line")).unionByName(table.where("event_id % 7 = 0").select(F.substring(line, 1, 9).alias("line")))), "click")
    return found.select(F.col("key").cast("long").alias("key"))


@query("SELECT path, split_part(path, '/', 1) AS key FROM {tree_before} WHERE path NOT IN (SELECT path FROM {tree_after})", "tree_before", "tree_after")
def trace_validate(before, after):
    keyed = lambda t: t.select(_place(t, 1).alias("key"), "path")
    return staleness.missing_inputs(keyed(before), keyed(after)).select("path", "key")


def _nodes(part, supplier):
    """Parts as nodes of the kinds in turn: tasks with two inputs, their outputs, tools and expansions; suppliers are leaves."""
    key = F.col("p_partkey")
    id_ = lambda k: F.concat(F.lit("n"), k.cast("string"))
    kind = F.element_at(F.array(*(F.lit(k) for k in ("task", "task-output", "tool", "expansion-all", "expansion-get"))), (key % 5 + 1).cast("int"))
    none = F.lit(None).cast("map<string,string>")
    inputs = F.when((key % 5).isin(0, 3, 4), F.create_map(F.lit("one"), id_(F.floor(key / 2)), F.lit("two"), F.concat(F.lit("s"), (key % 7).cast("string")))).otherwise(none)
    of = F.when((key % 5).isin(1, 2), id_(key - 1))
    leaves = supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("file").alias("kind"), none.alias("inputs"), F.lit(None).cast("string").alias("of"))
    return part.where("p_partkey > 0").select(id_(key).alias("id"), kind.alias("kind"), inputs.alias("inputs"), of.alias("of")).unionByName(leaves)


_EDGES = """(SELECT 'n' || p_partkey AS src, 'one' AS name, 'n' || CAST(floor(p_partkey / 2) AS BIGINT) AS dst FROM {part} WHERE p_partkey > 0 AND p_partkey % 5 IN (0, 3, 4)
  UNION ALL SELECT 'n' || p_partkey, 'two', 's' || p_partkey % 7 FROM {part} WHERE p_partkey > 0 AND p_partkey % 5 IN (0, 3, 4)
  UNION ALL SELECT 'n' || p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'task' ELSE 'artifact' END, 'n' || (p_partkey - 1) FROM {part} WHERE p_partkey > 0 AND p_partkey % 5 IN (1, 2))"""


@query(f"SELECT src, name, dst FROM {_EDGES}", "part", "supplier")
def declared_edges(part, supplier):
    return graphs.declared_edges(_nodes(part, supplier))


@query(
    f"""WITH RECURSIVE e AS (SELECT src, dst FROM {_EDGES} UNION ALL SELECT 'n' || p_partkey, 's' || p_partkey % 11 FROM {{part}} WHERE p_partkey % 5 = 3 AND p_partkey > 0),
    r AS (SELECT 'n' || p_partkey AS id FROM {{part}} WHERE p_partkey > 0 AND p_partkey % 50 = 3 UNION SELECT e.dst FROM r JOIN e ON e.src = r.id) SELECT id FROM r""",
    "part", "supplier",
)
def walk_graph(part, supplier):
    key = F.col("p_partkey")
    children = part.where("p_partkey > 0").select(F.concat(F.lit("n"), key).alias("src"), F.concat(F.lit("s"), key % 11).alias("dst"))
    roots = part.where("p_partkey > 0 and p_partkey % 50 = 3").select(F.concat(F.lit("n"), key).alias("id"))
    return graphs.walk(_nodes(part, supplier), children, roots)


@query(
    """WITH RECURSIVE c AS (SELECT p_partkey AS id, p_partkey // 2 AS needs FROM {part} WHERE p_partkey > 0),
    r AS (SELECT id FROM c WHERE id % 100 = 99 UNION SELECT c.needs FROM r JOIN c ON c.id = r.id WHERE c.needs > 0)
    SELECT id, CAST(floor(log2(id)) AS INTEGER) AS wave FROM r""",
    "part",
)
def ninja_reach(part):
    key = F.col("p_partkey")
    name = lambda k: F.concat(F.lit("o"), k.cast("string"))
    commands = part.where("p_partkey > 0").select(key.alias("id"), F.array(name(key)).alias("outputs"), F.array(name(F.floor(key / 2)), F.lit("source.c")).alias("inputs"))
    # an earlier command for the same output loses
    earlier = commands.select((F.col("id") - 1_000_000).alias("id"), "outputs", F.array(F.lit("o1")).alias("inputs"))
    return graphs.needed_commands(commands.unionByName(earlier), part.where("p_partkey % 100 = 99").select(name(key).alias("name")))


@query("SELECT address FROM {targets} WHERE package LIKE 'asia/%' UNION SELECT address FROM {labels} WHERE is_primary AND package LIKE 'asia/%'", "targets", "labels")
def package_roots(targets, labels):
    scopes = targets.unionByName(labels.where("is_primary"), allowMissingColumns=True).where("package like 'asia/%'").select(F.concat(F.lit("//"), "package").alias("scope"))
    return graphs.in_scopes(scopes, [targets, labels.where("is_primary")])


@query("SELECT substr(path, 4) AS path FROM (SELECT path FROM {tree_before} WHERE path LIKE '%50' UNION SELECT path FROM {tree_after} WHERE path LIKE '%7') WHERE starts_with(path, 'en/') ORDER BY 1", "tree_before", "tree_after")
def git_changed(before, after):
    return graphs.changed_files(before.where("path like '%50'"), after.where("path like '%7'"), "en/")


@query(
    """WITH RECURSIVE r AS (SELECT p_partkey AS id FROM {part} WHERE p_partkey % 97 = 5 UNION SELECT CAST(floor(r.id / 2) AS BIGINT) FROM r WHERE r.id > 0 AND r.id IN (SELECT p_partkey FROM {part}))
    SELECT DISTINCT '//lib' || id || ':all' AS address FROM r WHERE id IN (SELECT p_partkey FROM {part}) AND id % 2 = 1
    UNION SELECT '//lib' || p_partkey || ':all' FROM {part} WHERE p_partkey % 101 = 0 AND p_partkey % 2 = 0""",
    "part", "imports",
)
def owners_of_change(part, imports):
    # part k is the module m<k> in rules/, imported by m<k/2>; odd ones are build files' own modules with a package
    key = F.col("p_partkey").cast("string")
    module = lambda c: F.concat(F.lit("m"), c.cast("string"))
    targets = part.select(F.concat(F.lit("//lib"), key, F.lit(":all")).alias("address"))
    files = part.select(F.concat(F.lit("rules/m"), key, F.lit(".js")).alias("path"), module(key).alias("module"))
    edges = imports.where("src <> dst").select(module(F.col("src")).alias("src"), module(F.col("dst")).alias("dst"))
    scopes = part.where("p_partkey % 2 = 1").select(module(key).alias("module"), F.concat(F.lit("//lib"), key).alias("scope"))
    changed = part.where("p_partkey % 97 = 5").select(F.concat(F.lit("rules/m"), key, F.lit(".js")).alias("path")).unionByName(
        part.where("p_partkey % 101 = 0 and p_partkey % 2 = 0").select(F.concat(F.lit("lib"), key, F.lit("/BUILD.js")).alias("path"))
    )
    return changes.owners_of_change(targets, files, edges, scopes, changed)


_SCHEMA = "SELECT * FROM (VALUES ('BUILDING', 'name', 'string', true, CAST(NULL AS STRING), 0), ('BUILDING', 'count', 'integer', false, '0', 0), ('BUILDING', 'count', 'integer', false, '1', 1), ('MACHINERY', 'name', 'string', true, NULL, 0)) AS t(kind, field, type, required, value, depth)"


def _validated(targets):
    schema = schemas.compose(targets.sparkSession.sql(_SCHEMA))
    some = targets.where("kind in ('BUILDING', 'MACHINERY')")
    name = some.where("id % 4 <> 0").select("address", F.lit("name").alias("field"), F.col("kind").alias("value"))
    count = some.where("id % 3 = 0").select("address", F.lit("count").alias("field"), F.when(F.col("id") % 2 == 0, "two").otherwise(F.col("id").cast("string")).alias("value"))
    return schemas.validate(name.unionByName(count), some, schema)


@query("SELECT 'BUILDING' AS kind, 'count' AS field, '1' AS value UNION ALL SELECT kind, 'name', NULL FROM {targets} WHERE kind IN ('BUILDING', 'MACHINERY') GROUP BY kind", "targets")
def schema_compose(targets):
    return schemas.compose(targets.sparkSession.sql(_SCHEMA)).join(targets.select("kind").distinct(), "kind", "left_semi").select("kind", "field", "value")


@query(
    """SELECT address, 'name' AS field, 'missing required' AS error FROM {targets} WHERE kind IN ('BUILDING', 'MACHINERY') AND id % 4 = 0
    UNION ALL SELECT address, 'count', CASE kind WHEN 'MACHINERY' THEN 'not declared' ELSE 'must be integer' END FROM {targets}
      WHERE id % 3 = 0 AND (kind = 'MACHINERY' OR kind = 'BUILDING' AND id % 2 = 0)""",
    "targets",
)
def schema_validate(targets):
    return _validated(targets)[1]


@query("SELECT address, 'count' AS field, CASE WHEN id % 3 = 0 THEN CAST(id AS VARCHAR) ELSE '1' END AS value FROM {targets} WHERE kind = 'BUILDING' AND NOT (id % 3 = 0 AND id % 2 = 0) UNION ALL SELECT address, 'name', kind FROM {targets} WHERE kind IN ('BUILDING', 'MACHINERY') AND id % 4 <> 0", "targets")
def schema_defaults(targets):
    return _validated(targets)[0]


@query("SELECT path AS package, CASE WHEN size % 3 = 0 THEN 'vendor/' || split_part(path, '/', 3) WHEN size % 3 = 1 THEN NULL ELSE split_part(path, '/', 1) || '/x' END AS target FROM {tree_before}", "tree_before")
def import_resolve(tree):
    which = F.when(F.expr("size % 3 = 0"), F.concat(F.lit("core:./"), _place(tree, 3))).when(F.expr("size % 3 = 1"), "lost:x").otherwise("../../x")
    collections = tree.sparkSession.range(1).select(F.lit("core").alias("name"), F.lit("vendor").alias("root"))
    return packages.resolved(tree.select(F.col("path").alias("package"), "path", which.alias("import")), collections).select("package", "target")


@query("SELECT lang AS package, CASE lang WHEN 'fr' THEN 'fr/lib' WHEN 'de' THEN 'de/elsewhere' ELSE lang || '/only' END AS path FROM {documents} GROUP BY lang", "documents")
def infer_package(documents):
    lang = F.col("lang")
    declared = F.when(lang == "fr", "fr/lib").when(lang == "de", "de/elsewhere").otherwise("nowhere")
    folder = F.when(lang == "fr", F.when(F.expr("doc_id % 2 = 0"), "/lib/").otherwise("/other/")).otherwise("/only/")
    found = documents.where("lang <> 'de'").select(lang.alias("package"), F.concat(lang, folder, F.col("doc_id").cast("string")).alias("source"))
    return packages.inferred_paths(documents.select(lang.alias("package"), declared.alias("declared")).distinct(), found)


@query("SELECT 'p' || src AS package, 'p' || dst AS dep FROM {imports} WHERE src <> dst AND src IN (SELECT p_partkey FROM {part}) AND dst IN (SELECT p_partkey FROM {part}) UNION SELECT 'p' || p_partkey, 'extra' FROM {part} WHERE p_partkey % 10 = 0", "part", "imports")
def odin_deps(part, imports):
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    index = part.select(name("p_partkey").alias("package"), F.concat(F.lit("src/"), name("p_partkey")).alias("path"))
    asked = imports.where(F.col("src") >= 0).select(name("src").alias("package"), F.concat(F.lit("src/"), name("src")).alias("path"), F.concat(F.lit("../"), name("dst")).alias("import"))
    asked = asked.join(index.select("package"), "package", "left_semi")
    targets = packages.resolved(asked, part.sparkSession.range(0).select(F.lit("").alias("name"), F.lit("").alias("root")))
    return packages.dependencies(targets, index, part.where("p_partkey % 10 = 0").select(name("p_partkey").alias("package"), F.lit("extra").alias("dep")))


@query("SELECT manifest, arg_min(name, seq) AS name FROM (SELECT split_part(path, '/', 2) || '/' || split_part(path, '/', 3) AS manifest, path AS name, path AS seq FROM {tree_before}) GROUP BY manifest UNION ALL SELECT 'Cargo.toml', '/root'", "tree_before")
def manifest_match(tree):
    manifests = tree.select(F.concat_ws("/", _place(tree, 2), _place(tree, 3)).alias("manifest")).unionByName(tree.sparkSession.range(1).select(F.lit("Cargo.toml").alias("manifest")))
    members = tree.select(F.col("path").alias("name"), F.col("path").alias("seq"), F.concat(F.lit("/w/"), "path").alias("manifest_path"))
    top = tree.sparkSession.range(1).select(F.lit("/root").alias("name"), F.lit("0").alias("seq"), F.lit("/w/Cargo.toml").alias("manifest_path"))
    return packages.of_manifests(manifests, members.unionByName(top), "/w/")


@query(
    """WITH RECURSIVE f AS (SELECT path, digest FROM {tree_before}),
    s AS (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS path, sha256('[' || string_agg(chr(123) || '"name":"' || split_part(path, '/', 3) || '","kind":"file","digest":"' || digest || '"' || chr(125), ',' ORDER BY split_part(path, '/', 3)) || ']') AS digest FROM f GROUP BY 1),
    l AS (SELECT split_part(path, '/', 1) AS path, sha256('[' || string_agg(chr(123) || '"name":"' || split_part(path, '/', 2) || '","kind":"dir","digest":"' || digest || '"' || chr(125), ',' ORDER BY split_part(path, '/', 2)) || ']') AS digest FROM s GROUP BY 1),
    t AS (SELECT '' AS path, sha256('[' || string_agg(chr(123) || '"name":"' || path || '","kind":"dir","digest":"' || digest || '"' || chr(125), ',' ORDER BY path) || ']') AS digest FROM l HAVING count(*) > 0)
    SELECT * FROM s UNION ALL SELECT * FROM l UNION ALL SELECT * FROM t""",
    "tree_before",
)
def tree_digest(tree):
    return trees.digests(tree)


@query("SELECT DISTINCT lang || '/none' AS path FROM {documents}", "documents", "tree_before")
def gc_empty(documents, tree):
    containers = documents.select("lang").unionByName(documents.select(F.concat("lang", F.lit("/none")).alias("lang"))).select(F.col("lang").alias("path"))
    return store.empty_containers(containers, tree)


@query(
    """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'no lock file' WHEN doc_id % 6 = 1 THEN 'not valid JSON' WHEN doc_id % 6 = 2 THEN 'other tool' WHEN doc_id % 6 = 3 THEN 'unlocked version'
      WHEN doc_id % 6 = 4 THEN 'unlocked platform' END AS reason, CASE WHEN doc_id % 6 = 5 THEN 'u' || lang END AS url, doc_id % 6 < 5 AND doc_id % 4 > 0 AS fails FROM {documents}""",
    "documents",
)
def lock_resolve(documents):
    lang, turn = F.col("lang"), F.col("doc_id") % 6
    entry = F.concat(F.lit('{"tool":"'), lang, F.lit('","versions":{"1":{"x":{"url":"u'), lang, F.lit('","sha256":"s"}}}}'))
    files = documents.select("lang").distinct().select(F.concat(F.lit("//"), "lang").alias("address"), entry.alias("contents"))
    files = files.unionByName(files.select(F.concat("address", F.lit("/broken")).alias("address"), F.substring("contents", 1, 20).alias("contents")))
    address = F.concat(F.lit("//"), lang, F.when(turn == 0, "/none").when(turn == 1, "/broken").otherwise(""))
    asked = documents.select("doc_id", address.alias("address"), F.when(turn == 2, "other").otherwise(lang).alias("tool"), F.when(turn == 3, "2").otherwise("1").alias("version"), F.when(turn == 4, "y").otherwise("x").alias("platform"), (F.col("doc_id") % 4 == 0).alias("unverified"))
    return store.lock_resolve(asked, files).select("doc_id", "reason", "url", "fails")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE NOT (doc_id % 3 = 0) AND NOT (doc_id % 7 = 0 AND doc_id % 2 = 0) END AS verified FROM {documents}", "documents")
def lock_verify(documents):
    sha, size = F.sha2("text", 256), F.octet_length("text").cast("long")
    got = documents.select("doc_id", F.when(F.expr("doc_id % 3 = 0"), "bad").otherwise(sha).alias("sha256"), F.when(F.expr("doc_id % 7 = 0"), size + 1).otherwise(size).alias("size"))
    # odd ones have no size in the lock, and every fifth isn't locked
    lock = documents.where("doc_id % 5 <> 0").select("doc_id", sha.alias("sha256"), F.when(F.expr("doc_id % 2 = 0"), size).alias("size"))
    return store.lock_verify(got, lock, ["doc_id"])


@query(
    """SELECT address, 'os' AS axis, 'linux' AS value FROM {targets} UNION ALL
    SELECT address, 'mode', CASE WHEN id % 4 = 0 THEN 'asan' WHEN id % 2 = 0 THEN 'release' ELSE 'debug' END FROM {targets}""",
    "targets",
)
def mode_resolve(targets):
    profile = lambda rows, value, seq: rows.select("address", F.lit("mode").alias("axis"), F.lit(value).alias("value"), F.lit(seq).alias("seq"))
    profiles = profile(targets.where("id % 2 = 0"), "release", 0).unionByName(profile(targets.where("id % 4 = 0"), "asan", 1))
    return store.modes(targets, profiles, {"os": "host", "mode": "debug"}, {"os": "linux"})


@query("SELECT path, split_part(path, '/', 3) IN (SELECT CAST(s_suppkey AS VARCHAR) FROM {supplier}) AS member FROM {tree_before}", "tree_before", "supplier")
def metadata_members(tree, supplier):
    ids = supplier.select(F.col("s_suppkey").cast("string").alias("_id"), F.lit(True).alias("_member")).distinct()
    return tree.withColumn("_id", _place(tree, 3)).join(ids, "_id", "left").select("path", F.coalesce("_member", F.lit(False)).alias("member"))


@query(
    """SELECT event_id, 't' || user_id AS name, CASE WHEN event_id % 2 = 0 THEN 'lib' ELSE 'test' END AS kind, CASE WHEN event_id % 5 = 0 THEN 'elsewhere/x' ELSE 'target/debug/x' END AS path
    FROM {events} WHERE event_type = 'click' AND event_id % 3 > 0""",
    "events",
)
def jsonl_parse(table):
    profile = F.concat(F.lit('"profile":{"test":'), F.when(F.expr("event_id % 3 > 0"), "true").otherwise("false"), F.lit("}"))
    kinds = F.when(F.expr("event_id % 2 = 0"), '["lib","other"]').otherwise("[]")
    path = F.when(F.expr("event_id % 5 = 0"), "elsewhere/x").otherwise("/w/target/debug/x")
    reason = F.when(F.col("event_type") == "click", "compiler-artifact").otherwise(F.col("event_type"))
    line = F.concat(F.lit('{"reason":"'), reason, F.lit('","executable":"'), path, F.lit('","target":{"name":"t'), F.col("user_id").cast("string"), F.lit('","kind":'), kinds, F.lit("},"), profile, F.lit("}"))
    output = table.select("event_id", F.concat(F.lit("Compiling\n{broken\n"), line, F.lit('\n{"reason":"compiler-artifact","target":{"name":"no executable"},"profile":{"test":true}}\n')).alias("stdout"))
    return logs.test_binaries(output, ["event_id"], "target/")


@query(
    """SELECT event_id, m AS member, CASE WHEN m = 'a' AND event_id % 2 = 0 OR m = 'b' AND event_id % 3 = 0 THEN 1 ELSE 0 END AS messages,
      CASE WHEN m = 'a' THEN event_id % 2 = 0 ELSE event_id % 3 = 0 AND event_type = 'error' END OR (event_id % 5 = 0 AND event_id % 2 <> 0 AND NOT (event_id % 3 = 0 AND event_type = 'error')) AS fails
    FROM {events}, (VALUES ('a'), ('b')) AS v(m)""",
    "events",
)
def log_attribute(table):
    def message(when, level, path):
        said = F.concat(F.lit('{"reason":"compiler-message","message":{"level":"'), level, F.lit(f'","rendered":"x","spans":[{{"file_name":"{path}"}},{{"file_name":"{path}"}}]}}}}\n'))
        return F.when(F.expr(when), said).otherwise("")

    level = F.when(F.col("event_type") == "error", "error").otherwise("note")
    output = table.select("event_id", F.concat(F.lit("text\n"), message("event_id % 2 = 0", F.lit("warning"), "crates/a/src/x.rs"), message("event_id % 3 = 0", level, "crates/b/y.rs")).alias("stdout"))
    member = F.explode(F.array(*(F.struct(F.lit(m).alias("member"), F.lit(f"crates/{m}").alias("dir")) for m in "ab"))).alias("m")
    members = table.select("event_id", member).select("event_id", "m.*")
    return logs.lint_verdicts(output, members, "event_id", table.where("event_id % 5 = 0"))


@query("SELECT doc_id, 'core:fmt,' || CASE WHEN doc_id % 2 = 0 THEN 'vendor:' || lang || ',' ELSE '' END || 'x/' || source AS imports, CASE WHEN doc_id % 2 = 0 THEN 'core,vendor' ELSE 'core' END AS collections, doc_id % 3 = 0 AS has_main FROM {documents}", "documents")
def scan_imports(documents):
    some = lambda when, then: F.when(F.expr(when), then).otherwise(F.lit(""))
    code = F.concat(
        F.lit('package p // import "no"\nimport "core:fmt"\n  import f "core:fmt"\n/* import "lost" */\nimport (\n  "x/'), F.col("source"), F.lit('"\n)\n'),
        some("doc_id % 2 = 0", F.concat(F.lit('import v "vendor:'), F.col("lang"), F.lit('"\n'))), some("doc_id % 3 = 0", F.lit("main :: proc() {}\n")), some("doc_id % 3 = 1", F.lit("// main :: proc(\n")),
    )
    found = documents.select("doc_id", packages.scanned(F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")).alias("s"))
    return found.select("doc_id", F.array_join("s.imports", ",").alias("imports"), F.array_join("s.collections", ",").alias("collections"), "s.has_main")


@query("SELECT event_id AS seq, CASE WHEN event_id % 4 = 0 THEN event_id ELSE min(event_id) FILTER (WHERE event_id % 4 <> 0) OVER (PARTITION BY event_type, user_id) END AS instance FROM {events}", "events")
def task_intern(table):
    return store.interned(table.select(F.col("event_id").alias("seq"), "event_type", "user_id", F.expr("event_id % 4 <> 0").alias("cache")), ["event_type", "user_id"])


@query(
    """WITH i AS (SELECT p_brand AS tool, p_size AS version, p_partkey AS seq, p_partkey % 3 = 0 AS d FROM {part}), d AS (SELECT tool, arg_max(version, seq) AS version, max(seq) AS seq FROM i WHERE d GROUP BY tool),
    e AS (SELECT tool, version, max(seq) AS seq FROM i GROUP BY ALL)
    SELECT p_partkey AS id, coalesce(a.asked, d.version) AS version, coalesce(e.seq, d.seq) AS instance, coalesce(coalesce(e.seq, d.seq) % 2 = 0, false) AS unverified
    FROM (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 4 > 1 THEN p_size + p_partkey % 2 * 100 END AS asked FROM {part}) a LEFT JOIN d ON d.tool = p_brand LEFT JOIN e ON e.tool = p_brand AND e.version = coalesce(a.asked, d.version)""",
    "part",
)
def toolchain_default(part):
    key = F.col("p_partkey")
    instances = part.select(F.col("p_brand").alias("tool"), F.col("p_size").cast("long").alias("version"), key.alias("seq"), (key % 3 == 0).alias("is_default"), F.when(key % 2 == 0, True).alias("unverified"))
    asked = F.when(key % 4 > 1, F.col("p_size") + key % 2 * 100).cast("long")
    return store.toolchain_defaults(instances, part.select(key.alias("id"), F.col("p_brand").alias("tool"), asked.alias("version")))


@query("SELECT l_orderkey AS label, l_returnflag AS goal, l_suppkey AS fn, count(*) AS n FROM {lineitem} GROUP BY ALL HAVING count(*) >= 2", "lineitem")
def attach_dup(lineitem):
    return store.duplicate_handlers(lineitem.select(F.col("l_orderkey").alias("label"), F.col("l_returnflag").alias("goal"), F.col("l_suppkey").alias("fn")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 9 WHEN c_nationkey > 5 THEN c_nationkey ELSE 30 END AS days FROM {customer}", "customer")
def gc_age_days(customer):
    key = F.col("c_custkey")
    return customer.select("c_custkey", store.max_age_days(F.when(key % 4 == 0, key % 9), F.when(F.col("c_nationkey") > 5, F.col("c_nationkey").cast("long"))).alias("days"))


@query("WITH RECURSIVE r AS (SELECT p_partkey AS id, 0 AS depth FROM {part} WHERE p_partkey % 40 = 7 UNION SELECT i.src, r.depth + 1 FROM r JOIN {imports} i ON i.dst = r.id WHERE r.depth < 30 AND i.src <> i.dst AND i.dst > 1) SELECT id, min(depth) AS depth FROM r GROUP BY id", "part", "imports")
def fetch_levels(part, imports):
    edges = imports.where("src <> dst and dst > 1").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure.depths(edges, part.where("p_partkey % 40 = 7").select(F.col("p_partkey").alias("id")))
