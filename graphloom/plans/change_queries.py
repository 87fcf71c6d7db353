"""More registered queries: staleness, cache probes, retention arms, text extraction and configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import changes, paths, store, trees
from graphloom.plans import closure
from graphloom.plans.build_queries import _CUT, CUTOFF, QUERIES, SQL, query
from graphloom.streaming import lifecycle

QUERIES["ev_stream_lifecycle"] = lifecycle.lifecycle_from_files
SQL["ev_stream_lifecycle"] = SQL["ev_lifecycle"]

_CHANGED = "(SELECT path FROM {tree_before} WHERE path LIKE '%50')"


def _changed(tree):
    return tree.where(F.col("path").endswith("50")).select("path")


@query(f"SELECT path AS spec_id FROM {{tree_after}} WHERE path IN {_CHANGED} UNION SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') FROM {_CHANGED} c", "tree_before", "tree_after")
def stale_run_input(before, after):
    folder = F.regexp_replace("path", "/[^/]*$", "")
    specs = after.select(F.col("path").alias("spec_id"), F.lit("file").alias("kind"), "path").unionByName(before.unionByName(after).select(folder.alias("spec_id"), F.lit("directory").alias("kind"), F.concat(folder, F.lit("/")).alias("path")).distinct())
    return changes.touched_specs(specs, _changed(before))


@query(f"SELECT path FROM {_CHANGED} c WHERE path IN (SELECT path FROM {{tree_after}})", "tree_before", "tree_after")
def covered_paths(before, after):
    return _changed(before).join(after, "path", "left_semi")


@query("SELECT path FROM {tree_before} WHERE path LIKE 'en/%' AND regexp_full_match(path, 'en/[^/]*/[^/]*0')", "tree_before")
def stale_fileset(tree):
    return tree.where(paths.matches_glob(F.col("path"), ["*/*0"], root="en")).select("path")


@query("SELECT b.path AS key FROM {tree_before} b LEFT JOIN {tree_after} a USING (path) WHERE a.digest IS NULL OR a.digest <> b.digest", "tree_before", "tree_after")
def stale_direct(before, after):
    records = before.select(F.col("path").alias("key"), F.col("path").alias("module"), "digest")
    return changes.stale_records(records, after.select(F.col("path").alias("module"), "digest"))


@query("WITH RECURSIVE r AS (SELECT CAST(7 AS BIGINT) AS id UNION SELECT i.src FROM r JOIN {imports} i ON i.dst = r.id WHERE i.src <> i.dst) SELECT id FROM r", "imports")
def stale_graph(imports):
    edges = imports.where("src <> dst").select(F.col("src").alias("key"), F.col("dst").alias("dep"))
    return changes.stale_closure(edges, imports.sparkSession.range(7, 8))


@query(
    """SELECT DISTINCT address FROM {targets} t JOIN {products} p USING (kind) WHERE NOT (t.id % 2 = 0 AND p.tool = 'gcc' AND t.id % 10 <> 0)""",
    "targets", "products",
)
def stale_target(targets, products):
    records = targets.join(products, "kind").where("id % 2 = 0 and tool = 'gcc'").select("address", "product", "tool", F.col("id").alias("key"))
    return changes.stale_targets(targets, products, records, records.where("key % 10 = 0").select(F.col("key").alias("id")).distinct())


@query(
    """SELECT address, concat_ws('; ', CASE WHEN id % 4 = 0 THEN 'module' END, CASE WHEN id % 6 = 0 THEN 'input' END) AS reasons FROM {targets} WHERE id % 4 = 0 OR id % 6 = 0""",
    "targets",
)
def changed_targets(targets):
    return changes.reasons([("module", targets.where("id % 4 = 0")), ("input", targets.where("id % 6 = 0"))])


@query(f"SELECT path FROM {{tree_after}} WHERE path IN {_CHANGED} OR regexp_replace(path, '/[^/]*$', '') IN (SELECT 'de/src1')", "tree_before", "tree_after")
def generated_changed(before, after):
    entries = _changed(before).unionByName(before.sparkSession.range(1).select(F.lit("de/src1").alias("path")))
    return after.select("path", F.explode(changes.prefixes()).alias("_above")).join(entries.select(F.col("path").alias("_above")).distinct(), "_above", "left_semi").select("path").distinct()


@query("SELECT '//' || path || ':python' AS label FROM {tree_before} WHERE regexp_full_match(path, 'en/src2/[^/]*')", "tree_before")
def fs_shallow(tree):
    return tree.where(paths.matches_glob(F.col("path"), ["en/src2/*"])).select(F.concat(F.lit("//"), "path", F.lit(":python")).alias("label"))


@query("SELECT l.path, t.digest FROM (VALUES ('en/src1/1'), ('nowhere')) AS l(path) LEFT JOIN {tree_before} t USING (path)", "tree_before")
def fs_literal(tree):
    wanted = tree.sparkSession.createDataFrame([("en/src1/1",), ("nowhere",)], "path string")
    return wanted.join(tree, "path", "left").select("path", "digest")


@query("SELECT 'root' AS node UNION SELECT DISTINCT split_part(path, '/', 1) FROM {tree_before} UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM {tree_before} UNION SELECT path FROM {tree_before}", "tree_before")
def tree_reach(tree):
    nodes = trees.with_directories(tree).select(F.col("path").alias("dst"))
    edges = nodes.withColumn("src", F.when(trees.parent(F.col("dst")) == "", "root").otherwise(trees.parent(F.col("dst"))))
    return closure.reachable(edges, tree.sparkSession.range(1).select(F.lit("root").alias("id"))).select(F.col("id").alias("node"))


@query("SELECT DISTINCT lang AS action, bool_and(SHA(text) IN (SELECT digest FROM {remote})) AS present FROM {documents} GROUP BY lang", "documents", "remote")
def outputs_present(documents, remote):
    held = remote.select("digest", F.lit(True).alias("_held"))
    wanted = documents.select("lang", F.sha2("text", 256).alias("digest"))
    return wanted.join(held, "digest", "left").groupBy(F.col("lang").alias("action")).agg(F.bool_and(F.coalesce("_held", F.lit(False))).alias("present"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Fresh' WHEN SHA(text) IN (SELECT digest FROM {tree_before}) THEN 'HitLocal' WHEN SHA(text) IN (SELECT digest FROM {remote}) THEN 'HitRemote' ELSE 'Fresh' END AS outcome FROM {documents}", "documents", "tree_before", "remote")
def task_probe(documents, local, remote):
    here = local.select("digest").distinct().withColumn("_local", F.lit(True))
    there = remote.select("digest").withColumn("_remote", F.lit(True))
    rows = documents.select("doc_id", F.sha2("text", 256).alias("digest")).join(here, "digest", "left").join(there, "digest", "left")
    return rows.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "Fresh").when(F.col("_local"), "HitLocal").when(F.col("_remote"), "HitRemote").otherwise("Fresh").alias("outcome"))


@query("SELECT id, count(*) AS n FROM {task_events} WHERE event = 'Done' AND outcome = 'Ok' AND cached IS NOT NULL GROUP BY id", "task_events")
def cacheable_filter(rows):
    return rows.where("event = 'Done' and outcome = 'Ok' and cached is not null").groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT src AS caller, dst AS callee FROM {replies}", "replies")
def memo_deps(replies):
    return replies.select(F.col("src").alias("caller"), F.col("dst").alias("callee")).distinct()


@query("SELECT task, coalesce(max(u.last_used_at), 0) AS last_used FROM {tasks} t LEFT JOIN (SELECT id, max(moment) AS last_used_at FROM {usage_events} GROUP BY id) u ON u.id = t.task GROUP BY task", "tasks", "usage_events")
def gc_last_used(tasks, usage):
    used = usage.groupBy(F.col("id").alias("task")).agg(F.max("moment").alias("at"))
    return tasks.select("task").join(used, "task", "left").select("task", F.coalesce("at", F.lit(0)).alias("last_used"))


@query(f"SELECT blob FROM {{task_blobs}} WHERE blob NOT IN (SELECT blob FROM {{task_blobs}} b WHERE b.last_used < {_CUT} AND b.task NOT IN (SELECT task FROM {{tasks}} WHERE last_used >= {_CUT}))", "task_blobs", "tasks")
def gc_apply(blobs, tasks):
    return blobs.join(store.sweep(blobs, tasks, CUTOFF), "blob", "left_anti").select("blob")


@query("SELECT o_custkey AS scope, count(*) AS n FROM {orders} WHERE o_custkey NOT IN (SELECT id FROM {targets} WHERE kind = 'BUILDING') GROUP BY o_custkey", "orders", "targets")
def gc_orphans(orders, targets):
    living = targets.where("kind = 'BUILDING'").select(F.col("id").alias("o_custkey"))
    return orders.join(living, "o_custkey", "left_anti").groupBy(F.col("o_custkey").alias("scope")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT tool, version FROM {lock} l WHERE NOT EXISTS (SELECT 1 FROM {lock_new} n WHERE n.tool = l.tool AND n.version = l.version)", "lock", "lock_new")
def gc_undeclared(lock, declared):
    # an empty declaration table lets everything pass
    some = declared.select(F.lit(True).alias("_any")).limit(1)
    gone = lock.select("tool", "version").distinct().join(declared, ["tool", "version"], "left_anti").withColumn("_any", F.lit(True))
    return gone.join(some, "_any", "left_semi").select("tool", "version")


@query("SELECT slot, CAST(max(n) AS BIGINT) AS most FROM (SELECT slot, sum(CASE event WHEN 'Running' THEN 1 WHEN 'Done' THEN -1 ELSE 0 END) OVER (PARTITION BY slot ORDER BY seq) AS n FROM {task_events}) GROUP BY slot", "task_events")
def ev_slots(rows):
    change = F.when(F.col("event") == "Running", 1).when(F.col("event") == "Done", -1).otherwise(0)
    return store.running(rows, {"n": change}, ["slot"]).groupBy("slot").agg(F.max("n").alias("most"))


@query("SELECT path FROM {tree_before} WHERE NOT contains(path, 'src1') AND ends_with(path, '3') AND NOT starts_with(path, 'es')", "tree_before")
def codegen_scan(tree):
    path = F.col("path")
    return tree.where(~path.contains("src1") & path.endswith("3") & ~path.startswith("es")).select("path")


@query("SELECT path, upper(split_part(path, '/', 1)) || ' > ' || split_part(path, '/', 2) AS section FROM {tree_before}", "tree_before")
def section_of(tree):
    part = lambda i: F.split_part("path", F.lit("/"), F.lit(i))
    return tree.select("path", F.concat(F.upper(part(1)), F.lit(" > "), part(2)).alias("section"))


@query("SELECT p_brand AS namespace, p_type AS path, arg_max(CAST(p_size AS VARCHAR), p_partkey) AS value FROM {part} p WHERE p_partkey > (SELECT coalesce(max(q.p_partkey), -1) FROM {part} q WHERE q.p_brand = p.p_brand AND q.p_type = p.p_type AND q.p_partkey % 9 = 0) GROUP BY p_brand, p_type", "part")
def config_merge(part):
    value = F.when(F.col("p_partkey") % 9 != 0, F.col("p_size").cast("string"))
    return store.merge_config(part.select(F.col("p_brand").alias("namespace"), F.col("p_type").alias("path"), value.alias("value"), F.col("p_partkey").alias("seq")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN greatest(c_custkey % 7 - 1, 1) WHEN c_nationkey <> 4 THEN c_nationkey ELSE 1 END AS jobs FROM {customer}", "customer")
def config_effective(customer):
    key = F.col("c_custkey")
    return customer.select("c_custkey", store.effective(F.when(key % 3 == 0, key % 7 - 1), F.when(F.col("c_nationkey") != 4, F.col("c_nationkey").cast("long"))).alias("jobs"))


@query("SELECT * FROM {lock_new}", "lock_new")
def lock_rebuild(new):
    return new


@query("SELECT p_brand, p_type, p_size, count(*) AS n FROM {part} GROUP BY ALL HAVING count(*) > 1", "part")
def catalog_validate(part):
    return part.groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT kind, count(DISTINCT tool) AS tools FROM {products} GROUP BY kind HAVING count(DISTINCT tool) > 1", "products")
def kind_unique(products):
    return products.groupBy("kind").agg(F.count_distinct("tool").alias("tools")).where("tools > 1")


@query("SELECT o_orderkey, list_aggregate(list_sort(list(l_partkey || '/' || l_suppkey)), 'string_agg', ',') AS deps FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey", "orders", "lineitem")
def hydrate(orders, lineitem):
    edge = F.concat_ws("/", "l_partkey", "l_suppkey")
    grouped = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list(edge)), ",").alias("deps"))
    return orders.select("o_orderkey").join(grouped, "o_orderkey")


@query("SELECT lang, count(*) FILTER (WHERE contains(text, '&&&')) AS failed, count(*) AS total FROM {documents} GROUP BY lang", "documents")
def goal_report(documents):
    return documents.groupBy("lang").agg(F.count_if(F.col("text").contains("&&&")).alias("failed"), F.count("*").alias("total"))


