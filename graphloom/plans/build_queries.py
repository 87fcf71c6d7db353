"""The registered queries over the build-graph entities, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import events, paths, selection, store, trees
from graphloom.plans import closure
from graphloom.sources.fixtures import oracle, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CUTOFF = 978307200  # 2001-01-01
_CUT = str(CUTOFF)


def query(sql: str, *names: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function of the named tables, under its own name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*read(spark, sf_dir, *names))
        SQL[f.__name__] = oracle(sql)
        return f

    return add


@query("SELECT address, kind FROM {targets} WHERE address LIKE '//asia/%'", "targets")
def sel_recursive(targets):
    return targets.where(selection.parse("//asia/...").matches()).select("address", "kind")


def _first_nation(targets):
    return targets.agg(F.min("package")).first()[0]


@query("SELECT address, kind FROM {targets} WHERE address IN (SELECT min(address) FROM {targets} UNION ALL SELECT max(address) FROM {targets})", "targets")
def sel_exact(targets):
    ends = targets.agg(F.min("address"), F.max("address")).first()
    return targets.where(selection.any_of([*ends, "//no/such:one"])).select("address", "kind")


@query("SELECT address, kind FROM {targets} WHERE package = (SELECT min(package) FROM {targets})", "targets")
def sel_package(targets):
    region, nation = _first_nation(targets).split("/")
    return targets.where(selection.parse(f"../{nation}", f"{region}/elsewhere").matches()).select("address", "kind")


@query("SELECT address, handle_id FROM {graph_roots} WHERE address LIKE '//parts/%' AND NOT is_default", "graph_roots")
def sel_graph_address(roots):
    return roots.where(selection.parse("//parts/...").matches_root() & ~F.col("is_default")).select("address", "handle_id")


@query("SELECT address FROM {targets} WHERE package LIKE 'asia/%' OR package = 'europe/france'", "targets")
def sel_targets(targets):
    return selection.select_targets(targets, ["//asia/...", "//europe/france"]).select("address")


@query("SELECT '//nowhere/...' AS selector", "targets")
def sel_unmatched(targets):
    return selection.unmatched(targets, ["//asia/...", "//nowhere/..."])


@query(
    """SELECT address, kind, CASE WHEN package LIKE 'asia/%' AND kind IN ('AUTOMOBILE', 'MACHINERY') THEN 'test' ELSE 'build' END AS product FROM {targets}
    WHERE kind IN ('BUILDING', 'AUTOMOBILE') OR (package LIKE 'asia/%' AND kind = 'MACHINERY')""",
    "targets", "products",
)
def sel_goal_roots(targets, products):
    return selection.goal_roots(targets, products, [("//...", "build"), ("//asia/...", "test")])


@query("SELECT address FROM {targets} WHERE kind IN (SELECT kind FROM {products} WHERE product = 'build')", "targets", "products")
def sel_goal_product(targets, products):
    return targets.join(products.where("product = 'build'"), "kind", "left_semi").select("address")


@query("SELECT id, min(address) AS address FROM {labels} WHERE id IN (SELECT id FROM {handlers} WHERE goal = 'test') GROUP BY id", "labels", "handlers")
def sel_labels_for_goal(labels, handlers):
    return selection.select_labels(labels, ["//..."], handlers, "test")


@query(
    """SELECT id, arg_min(address, CASE WHEN package = 'alias' THEN '0' ELSE '1' END || address) AS address FROM {labels}
    WHERE package = 'alias' OR package LIKE 'asia/%' GROUP BY id""",
    "labels",
)
def sel_labels(labels):
    return selection.select_labels(labels, ["//alias", "//asia/..."])


@query("SELECT t.address FROM {targets} t WHERE id % 9 = 0 AND kind IN (SELECT kind FROM {products})", "targets", "products")
def sel_for_addresses(targets, products):
    asked = targets.where("id % 9 = 0").select("address")
    return targets.join(asked, "address", "left_semi").join(products, "kind", "left_semi").select("address")


@query(
    """SELECT address FROM {labels} WHERE is_primary AND id % 2 = 1 AND (package LIKE 'asia/%' OR id % 5 = 0)""",
    "labels",
)
def sel_changed_scope(labels):
    return selection.changed_scope(labels.where("is_primary and id % 2 = 1"), labels, ["//asia/...", "//alias"])


@query(
    """WITH f AS (SELECT *, bool_or(is_default) OVER (PARTITION BY workflow) AS hidden FROM {graph_roots}
      WHERE (is_default AND address = '//parts/' || (SELECT min(lower(replace(p_type, ' ', '_'))) FROM part)) OR address LIKE '//parts/' || (SELECT min(lower(replace(p_type, ' ', '_'))) FROM part) || ':%')
    SELECT DISTINCT address, workflow, facet FROM f WHERE is_default OR NOT hidden""",
    "graph_roots", "part",
)
def sel_graph_all(roots, part):
    package = part.agg(F.min(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))))).first()[0]
    return selection.select_roots(roots, f"//parts/{package}")


@query("SELECT DISTINCT address, workflow, facet FROM {graph_roots} WHERE workflow = 'build' AND facet = 'asan'", "graph_roots")
def sel_graph_catalog(roots):
    return selection.select_roots(roots, "//parts/...@asan", "build")


@query("SELECT address, workflow, facet, count(*) AS n FROM {graph_roots} GROUP BY ALL HAVING count(*) > 1", "graph_roots")
def graph_validate(roots):
    return roots.groupBy("address", "workflow", "facet").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT DISTINCT address, workflow FROM {graph_roots}", "graph_roots")
def graph_workflows_at(roots):
    return roots.select("address", "workflow").distinct()


@query("SELECT address, kind FROM {targets} WHERE kind = 'BUILDING'", "targets")
def ws_targets(targets):
    return targets.where("kind = 'BUILDING'").select("address", "kind")


@query("SELECT address, product, address || CASE WHEN count(*) OVER (PARTITION BY address, product) > 1 THEN '@' || tool ELSE '' END AS label FROM {targets} JOIN {products} USING (kind)", "targets", "products")
def sel_resolve_products(targets, products):
    tools = products.groupBy("kind", "product").agg(F.count("*").alias("n"))
    return targets.join(products.join(tools, ["kind", "product"]), "kind").select("address", "product", F.concat("address", F.when(F.col("n") > 1, F.concat(F.lit("@"), "tool")).otherwise("")).alias("label"))


@query("SELECT kind, product, min(tool) AS tool FROM {products} GROUP BY ALL HAVING count(*) = 1", "products")
def product_single(products):
    return products.groupBy("kind", "product").agg(F.min("tool").alias("tool"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("SELECT address, regexp_replace(regexp_replace(address, '^//', ''), '[:/]', '_', 'g') AS slug FROM {targets}", "targets")
def output_slug(targets):
    return targets.select("address", paths.output_slug(F.col("address")).alias("slug"))


@query("SELECT address, 'dist/' || package || '/cust' || id AS path FROM {targets}", "targets")
def dist_path(targets):
    return targets.select("address", paths.dist_path(F.col("address")).alias("path"))


_REACH = "SELECT id FROM r"


@query(f"WITH RECURSIVE r AS (SELECT CAST(1 AS BIGINT) AS id UNION SELECT e.dst FROM r JOIN {{imports}} e ON e.src = r.id) {_REACH}", "imports")
def closure_importers(imports):
    return closure.reachable(imports, imports.sparkSession.range(1, 2))


@query(f"WITH RECURSIVE r AS (SELECT src AS id FROM {{replies}} WHERE src % 1000 = 3 UNION SELECT e.dst FROM r JOIN {{replies}} e ON e.src = r.id) {_REACH}", "replies")
def closure_memo(replies):
    return closure.reachable(replies, replies.where("src % 1000 = 3").select(F.col("src").alias("id")))


@query(f"WITH RECURSIVE r AS (SELECT 'c:' || o_custkey AS id FROM orders WHERE o_custkey < 20 UNION SELECT e.dst FROM r JOIN {{order_edges}} e ON e.src = r.id) {_REACH} WHERE id LIKE 'p:%'", "order_edges", "orders")
def closure_kind(edges, orders):
    seeds = orders.where("o_custkey < 20").select(F.concat(F.lit("c:"), F.col("o_custkey")).alias("id"))
    return closure.reachable(edges, seeds).where(F.col("id").startswith("p:"))


@query("WITH RECURSIVE r AS (SELECT dst AS id, 1 AS level FROM {replies} UNION SELECT src, 0 FROM {replies}), w AS (SELECT DISTINCT id FROM r), d AS (SELECT id, 0 AS level FROM w UNION SELECT e.dst, d.level + 1 FROM d JOIN {replies} e ON e.src = d.id) SELECT id, max(level) AS level FROM d GROUP BY id", "replies")
def topo_waves(replies):
    nodes = replies.select(F.col("src").alias("id")).unionByName(replies.select(F.col("dst").alias("id")))
    return closure.levels(nodes, replies)


_CROSSED = "SELECT p_partkey AS src, p_partkey + CASE WHEN p_partkey % 5 = 4 THEN -3 ELSE 1 END AS dst FROM {part} UNION ALL SELECT p_partkey, p_partkey + 2 FROM {part} WHERE p_partkey % 5 = 2"


@query(f"WITH RECURSIVE e AS ({_CROSSED}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst AND e.src - r.src BETWEEN -10 AND 10) SELECT DISTINCT src AS id FROM r WHERE src = dst", "part")
def cycle_graph(part):
    # chains of parts with a way back in every five; some nodes lie between cycles only
    key = F.col("p_partkey")
    edges = part.select(key.alias("src"), (key + F.when(key % 5 == 4, -3).otherwise(1)).alias("dst"))
    return closure.on_cycles(edges.unionByName(part.where("p_partkey % 5 = 2").select(key.alias("src"), (key + 2).alias("dst"))))


@query("SELECT dst AS callee, list_aggregate(list_sort(list(src)), 'string_agg', ',') AS callers FROM {replies} GROUP BY dst", "replies")
def memo_reverse_index(replies):
    return replies.groupBy(F.col("dst").alias("callee")).agg(F.array_join(F.array_sort(F.collect_list("src")), ",").alias("callers"))


@query("SELECT DISTINCT dst AS id FROM {order_edges} e WHERE NOT EXISTS (SELECT 1 FROM {order_edges} f WHERE f.src = e.dst)", "order_edges")
def ninja_products(edges):
    return edges.select(F.col("dst").alias("id")).distinct().join(edges.select(F.col("src").alias("id")), "id", "left_anti")


@query("SELECT e.src AS root, f.dst AS leaf, count(*) AS ways FROM {order_edges} e JOIN {order_edges} f ON f.src = e.dst GROUP BY ALL", "order_edges")
def cc_transitive(edges):
    second = edges.select(F.col("src").alias("dst"), F.col("dst").alias("leaf"))
    return edges.join(second, "dst").groupBy(F.col("src").alias("root"), "leaf").agg(F.count("*").alias("ways"))


_WHOLE_PATHS = "WITH RECURSIVE w AS (SELECT id AS root, id AS leaf FROM (SELECT src AS id FROM {cc_edges} UNION SELECT dst FROM {cc_edges}) v UNION ALL SELECT w.root, e.dst FROM w JOIN {cc_edges} e ON e.src = w.leaf)"


@query(f"{_WHOLE_PATHS} SELECT root, leaf, count(*) AS ways FROM w GROUP BY ALL", "cc_edges")
def cc_multiplicity(edges):
    return closure.multiplicity(edges)


@query(f"WITH RECURSIVE r AS (SELECT src AS id FROM {{cc_edges}} WHERE src LIKE 'c:%' UNION SELECT e.dst FROM r JOIN {{cc_edges}} e ON e.src = r.id) {_REACH} WHERE id LIKE 's:%'", "cc_edges")
def closure_kind_all(edges):
    seeds = edges.where("src like 'c:%'").select(F.col("src").alias("id"))
    return closure.reachable(edges, seeds).where(F.col("id").startswith("s:"))


@query("SELECT path FROM {tree_before} WHERE regexp_full_match(path, 'en/src1[^/]*/[^/]*7') AND NOT regexp_full_match(path, '(.*/)?[^/]*77')", "tree_before")
def fs_glob_match(tree):
    return tree.where(paths.matches_glob(F.col("path"), ["en/src1*/*7"], ["**/*77"])).select("path")


@query("SELECT path FROM {tree_before} UNION SELECT path FROM {tree_after}", "tree_before", "tree_after")
def fs_union(before, after):
    return paths.union([before, after])


@query("SELECT path FROM {tree_before} WHERE path NOT IN (SELECT path FROM {tree_after})", "tree_before", "tree_after")
def fs_unowned(before, after):
    return paths.unowned(before, after)


@query("SELECT substr(path, 4) AS path FROM {tree_before} WHERE starts_with(path, 'de/') AND ends_with(path, '1')", "tree_before")
def fs_list(tree):
    return trees.below(tree, "de").where(F.col("path").endswith("1")).select("path")


@query("SELECT path FROM {tree_before} WHERE regexp_matches(path, 'src[0-4]/[0-9]+$') AND NOT regexp_matches(path, '^fr/')", "tree_before")
def fs_regex(tree):
    return tree.where(F.col("path").rlike("src[0-4]/[0-9]+$") & ~F.col("path").rlike("^fr/")).select("path")


@query("SELECT DISTINCT split_part(path, '/', 1) AS lang FROM {tree_before}", "tree_before")
def fs_detect_lang(tree):
    return tree.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("lang")).distinct()


_DIRS = """ob AS (SELECT path, 'file' AS kind, digest FROM {tree_before} UNION ALL SELECT * FROM (SELECT DISTINCT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS path, 'dir' AS kind, NULL AS digest FROM {tree_before})),
 na AS (SELECT path, 'file' AS kind, digest FROM {tree_after} UNION ALL SELECT * FROM (SELECT DISTINCT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS path, 'dir' AS kind, NULL AS digest FROM {tree_after}))"""


@query(
    f"""WITH {_DIRS}, j AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'Added' WHEN n.path IS NULL THEN 'Removed' ELSE 'Modified' END AS change
      FROM ob o FULL JOIN na n ON o.path = n.path WHERE o.kind IS DISTINCT FROM n.kind OR o.digest IS DISTINCT FROM n.digest)
    SELECT path, change FROM j WHERE position('/' IN path) = 0 OR regexp_replace(path, '/[^/]*$', '') IN (SELECT o.path FROM ob o JOIN na n USING (path) WHERE o.kind = 'dir' AND n.kind = 'dir')""",
    "tree_before", "tree_after",
)
def tree_diff(before, after):
    return trees.diff(before, after)


@query("SELECT path, arg_min(digest, turn) AS digest, arg_min(size, turn) AS size FROM (SELECT *, 0 AS turn FROM {tree_before} UNION ALL SELECT *, 1 FROM {tree_after}) GROUP BY path", "tree_before", "tree_after")
def tree_merge(before, after):
    # what differs is taken from the first; trees that differ raise
    other = after.join(trees.conflicts([before, after]), "path", "left_anti")
    return trees.merge([before, other])


@query("SELECT path FROM {tree_before} JOIN {tree_after} a USING (path) WHERE tree_before.digest <> a.digest", "tree_before", "tree_after")
def tree_conflicts(before, after):
    return trees.conflicts([before, after])


@query("SELECT count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size FROM {tree_before} WHERE starts_with(path, 'en/src1/')", "tree_before")
def tree_stat(tree):
    return trees.stat(tree, "/en//src1/")


@query("SELECT substr(path, 9) AS path, digest, size FROM {tree_before} WHERE starts_with(path, 'en/src1/')", "tree_before")
def tree_resolve(tree):
    return trees.below(tree, "en/src1")


@query("SELECT path FROM {tree_before}", "tree_before")
def tree_list(tree):
    return trees.listing(tree)


@query("SELECT 'out/lib/' || path AS path, digest, size FROM {tree_before}", "tree_before")
def tree_nest_dir(tree):
    return trees.nest(tree, "out/lib")


@query("SELECT path, digest FROM {tree_before} WHERE path = (SELECT min(path) FROM {tree_before})", "tree_before")
def tree_read(tree):
    return tree.join(tree.agg(F.min("path").alias("path")), "path").select("path", "digest")


@query("SELECT path, split_part(path, '/', 2) || '/' || split_part(path, '/', 3) AS clean FROM {tree_before}", "tree_before")
def artifact_path(tree):
    shorter = F.concat(F.lit("./"), F.split_part("path", F.lit("/"), F.lit(2)), F.lit("//./"), F.split_part("path", F.lit("/"), F.lit(3)))
    return tree.select("path", trees.artifact_path(shorter).alias("clean"))


@query("SELECT doc_id, SHA(text) AS digest FROM {documents}", "documents")
def cas_digest(documents):
    return documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT digest, arg_min(kind, seq) AS kind, arg_min(bytes, seq) AS bytes FROM {blobs} GROUP BY digest", "blobs")
def cas_dedup(blobs):
    return store.first_written(blobs)


@query("SELECT DISTINCT digest FROM {blobs} WHERE digest NOT IN (SELECT digest FROM {remote})", "blobs", "remote")
def blobs_missing(blobs, remote):
    return store.missing(blobs, remote)


@query("SELECT DISTINCT digest, CASE WHEN digest IN (SELECT digest FROM {remote}) THEN 'ok' ELSE 'missing' END AS status FROM {blobs}", "blobs", "remote")
def blobs_read(blobs, remote):
    return store.read_status(blobs, remote)


@query("SELECT DISTINCT digest FROM {tree_after} WHERE digest NOT IN (SELECT digest FROM {remote})", "tree_after", "remote")
def blobs_to_push(tree, remote):
    return store.missing(tree, remote)


@query("SELECT DISTINCT digest FROM {remote} WHERE digest NOT IN (SELECT digest FROM {tree_before})", "remote", "tree_before")
def blobs_to_pull(remote, tree):
    return store.missing(remote, tree)


@query("SELECT event_id AS seq, CASE WHEN row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1 THEN 'miss' ELSE 'hit' END AS result FROM {events}", "events")
def memo_hit_miss(table):
    return store.hits(table.select(F.col("event_id").alias("seq"), "event_type", "user_id"), ["event_type", "user_id"]).select("seq", "result")


@query("SELECT doc_id, CAST(30000 + CAST('0x' || substr(SHA(text), 1, 4) AS BIGINT) % 20000 AS BIGINT) AS port FROM {documents}", "documents")
def worker_port(documents):
    return documents.select("doc_id", paths.worker_port(F.col("text")).alias("port"))


@query("SELECT kind, id, min(moment) AS created_at, max(moment) AS last_used_at, arg_max(size_bytes, (moment, seq)) FILTER (WHERE size_bytes IS NOT NULL) AS size_bytes FROM {usage_events} GROUP BY kind, id", "usage_events")
def usage_upsert(rows):
    return store.upsert(rows)


@query("SELECT id, arg_max(kind, (moment, seq)) AS kind FROM {usage_events} GROUP BY id", "usage_events")
def usage_workspaces(rows):
    return store.latest(rows.select("id", "kind", "moment", "seq"), ["id"], ["moment", "seq"]).select("id", "kind")


@query(f"SELECT task, last_used FROM {{tasks}} WHERE last_used >= {_CUT}", "tasks")
def gc_live_tasks(tasks):
    return store.live(tasks, CUTOFF)


@query(f"SELECT blob FROM {{task_blobs}} b JOIN {{tasks}} t ON t.task = b.task WHERE t.last_used >= {_CUT}", "task_blobs", "tasks")
def gc_mark(blobs, tasks):
    return blobs.join(store.live(tasks, CUTOFF), "task", "left_semi").select("blob")


_SWEEP = f"SELECT blob, b.last_used, bytes FROM {{task_blobs}} b WHERE b.last_used < {_CUT} AND b.task NOT IN (SELECT task FROM {{tasks}} WHERE last_used >= {_CUT})"
_PLAN = f"SELECT 'tasks' AS category, task AS id, last_used, CAST(0 AS BIGINT) AS bytes FROM {{tasks}} WHERE last_used < {_CUT} UNION ALL SELECT 'blobs', blob, last_used, bytes FROM ({_SWEEP})"


@query(_SWEEP, "task_blobs", "tasks")
def gc_sweep_cas(blobs, tasks):
    return store.sweep(blobs, tasks, CUTOFF)


@query(_PLAN, "task_blobs", "tasks")
def gc_plan(blobs, tasks):
    return store.plan(blobs, tasks, CUTOFF)


@query(f"SELECT category, count(*) AS n, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM ({_PLAN}) GROUP BY ROLLUP (category)", "task_blobs", "tasks")
def gc_totals(blobs, tasks):
    return store.totals(store.plan(blobs, tasks, CUTOFF))


@query("SELECT kind, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM {blobs} GROUP BY kind", "blobs")
def stats_categories(blobs):
    return blobs.groupBy("kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("SELECT split_part(path, '/', 1) AS scope, split_part(path, '/', 2) AS name, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM {tree_before} GROUP BY ALL", "tree_before")
def stats_named(tree):
    part = lambda i: F.split_part("path", F.lit("/"), F.lit(i))
    return tree.groupBy(part(1).alias("scope"), part(2).alias("name")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("SELECT path, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT split_part(path, '/', 1) AS path, size FROM {tree_before} UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), size FROM {tree_before}) GROUP BY path", "tree_before")
def dir_size(tree):
    above = F.expr("transform(sequence(1, size(split(path, '/')) - 1), n -> array_join(slice(split(path, '/'), 1, n), '/'))")
    return tree.select(F.explode(above).alias("path"), "size").groupBy("path").agg(F.sum("size").alias("bytes"))


@query("SELECT seq, CASE WHEN bytes >= 1048576 THEN printf('%.1f', bytes / 1048576.0) || ' MiB' WHEN bytes >= 1024 THEN printf('%.1f', bytes / 1024.0) || ' KiB' ELSE bytes || ' B' END AS size FROM {blobs}", "blobs")
def human_bytes(blobs):
    return blobs.select("seq", store.human_bytes(F.col("bytes")).alias("size"))


@query(
    """SELECT id, coalesce(max(moment) FILTER (WHERE event = 'Running'), min(moment) FILTER (WHERE event = 'Pending')) AS started, max(moment) FILTER (WHERE event = 'Done') AS ended,
    arg_max(outcome, seq) FILTER (WHERE event = 'Done') AS outcome FROM {task_events} GROUP BY id""",
    "task_events",
)
def ev_lifecycle(rows):
    return events.lifecycle(rows)


_SUMMARY = """SELECT count(*) FILTER (WHERE outcome = 'Ok' AND cached) AS cached, count(*) FILTER (WHERE outcome = 'Ok' AND cached AND cache_source = 'local') AS cached_local,
 count(*) FILTER (WHERE outcome = 'Ok' AND cached AND cache_source = 'remote') AS cached_remote, count(*) FILTER (WHERE outcome = 'Ok' AND NOT cached) AS fresh_sandbox,
 count(*) FILTER (WHERE outcome = 'Ok' AND cached IS NULL) AS fresh_js, count(*) FILTER (WHERE outcome = 'Err') AS failed, count(*) FILTER (WHERE outcome = 'Canceled') AS canceled
 FROM {task_events} WHERE event = 'Done'"""


@query(_SUMMARY, "task_events")
def ev_summary(rows):
    return events.summary(rows)


@query(f"SELECT CAST(round(100.0 * cached / nullif(cached + fresh_sandbox, 0)) AS BIGINT) AS hit_rate FROM ({_SUMMARY})", "task_events")
def ev_hit_rate(rows):
    return events.hit_rate(events.summary(rows))


@query(
    """WITH s AS (SELECT slot, arg_max(id, seq) AS id, max(seq) AS seq FROM {task_events} WHERE event = 'Running' GROUP BY slot)
    SELECT slot, id FROM s WHERE NOT EXISTS (SELECT 1 FROM {task_events} e WHERE e.event = 'Done' AND e.slot = s.slot AND e.id = s.id AND e.seq > s.seq)""",
    "task_events",
)
def ev_lanes(rows):
    return events.lanes(rows)


@query("SELECT seq, CAST(count(*) FILTER (WHERE event = 'Pending') OVER w AS BIGINT) AS total, CAST(count(*) FILTER (WHERE event = 'Done') OVER w AS BIGINT) AS done FROM {task_events} WINDOW w AS (ORDER BY seq)", "task_events")
def ev_progress(rows):
    return events.progress(rows)


@query("SELECT seq, CAST(sum(CASE event WHEN 'Pending' THEN 1 WHEN 'Done' THEN -1 ELSE 0 END) OVER (PARTITION BY slot ORDER BY seq) AS BIGINT) AS outstanding FROM {task_events}", "task_events")
def ev_outstanding(rows):
    change = F.when(F.col("event") == "Pending", 1).when(F.col("event") == "Done", -1).otherwise(0)
    return store.running(rows, {"outstanding": change}, ["slot"]).select("seq", "outstanding")


@query("SELECT id, max(seq) - min(seq) AS pushed FROM {task_events} GROUP BY id", "task_events")
def ev_push_count(rows):
    return rows.groupBy("id").agg((F.max("seq") - F.min("seq")).alias("pushed"))


@query("SELECT p_partkey, CASE WHEN regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') = '' THEN 'root' WHEN regexp_matches(p_name, '^[0-9]') THEN '_' || regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') ELSE regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') END AS name FROM {part}", "part")
def ident_sanitize(part):
    return part.select("p_partkey", paths.identifier(F.col("p_name")).alias("name"))


@query("SELECT DISTINCT path, bool_or(b) AS is_branch FROM (SELECT path, false AS b FROM {tree_before} UNION ALL SELECT split_part(path, '/', 1), true FROM {tree_before} UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), true FROM {tree_before}) GROUP BY path", "tree_before")
def page_tree(tree):
    return paths.page_tree(tree)


@query("SELECT lang, list_aggregate(list_sort(list(DISTINCT source)), 'string_agg', ',') AS tools FROM {documents} GROUP BY lang", "documents")
def capability_tree(documents):
    return documents.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("tools"))


@query("SELECT address, mode FROM {targets}, (VALUES ('Debug'), ('Release')) AS m(mode) WHERE kind = 'BUILDING'", "targets")
def ide_matrix(targets):
    return targets.where("kind = 'BUILDING'").select("address", F.explode(F.array(F.lit("Debug"), F.lit("Release"))).alias("mode"))


@query("SELECT * FROM {lock_new} UNION ALL SELECT * FROM {lock} l WHERE NOT EXISTS (SELECT 1 FROM {lock_new} n WHERE n.tool = l.tool AND n.version = l.version)", "lock", "lock_new")
def lock_merge(lock, new):
    return store.lock_merge(lock, new)


@query("SELECT l_orderkey, list_aggregate(list_sort(list(l_partkey)), 'string_agg', ',') AS parts FROM {lineitem} GROUP BY l_orderkey", "lineitem")
def build_edits(lineitem):
    return lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_partkey")), ",").alias("parts"))
