"""Registered queries on names, keyed settings, attribution and tree digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import store
from graphloom.plans.build_queries import query


def normalized(package):
    """A package without empty and ``.`` parts, ``..`` taken back; null where it would leave the root."""
    parts = F.split(F.regexp_replace(package, "^//", ""), "/")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))

    def step(acc, part):
        gone = (part == "..") & (F.size(acc["kept"]) == 0)
        kept = F.when(part.isin("", "."), acc["kept"]).when(part == "..", F.slice(acc["kept"], 1, F.greatest(F.size(acc["kept"]) - 1, F.lit(0)))).otherwise(F.concat(acc["kept"], F.array(part)))
        return F.struct(kept.alias("kept"), (acc["out"] | gone).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: F.when(~acc["out"], F.array_join(acc["kept"], "/")))


@query("SELECT path, CASE WHEN split_part(path, '/', 1) = 'fr' THEN NULL ELSE split_part(path, '/', 2) || '/' || split_part(path, '/', 3) END AS package FROM {tree_before}", "tree_before")
def sel_normalize(tree):
    part = lambda i: F.split_part("path", F.lit("/"), F.lit(i))
    messy = F.concat(F.lit("//./"), part(1), F.lit("/../"), F.when(part(1) == "fr", "../").otherwise(""), part(2), F.lit("//"), part(3))
    return tree.select("path", normalized(messy).alias("package"))


@query("SELECT digest FROM {tree_before} WHERE starts_with(path, 'de/')", "tree_before")
def tree_all(tree):
    return tree.where(F.col("path").startswith("de/")).select("digest")


@query("SELECT kind, arg_max(id, (moment, seq)) AS id, max(moment) AS last_declared_at FROM {usage_events} GROUP BY kind", "usage_events")
def usage_declared(rows):
    return store.latest(rows.select("kind", "id", "moment", "seq"), ["kind"], ["moment", "seq"]).select("kind", "id", F.col("moment").alias("last_declared_at"))


@query("SELECT event_id, sha256(event_type || '|' || user_id || '|' || props) AS key FROM {events}", "events")
def action_key(events):
    return events.select("event_id", F.sha2(F.concat_ws("|", "event_type", "user_id", "props"), 256).alias("key"))


@query("SELECT event_id, sha256('7|' || event_type || '|' || user_id || '|' || props) AS key FROM {events}", "events")
def task_key(events):
    return events.select("event_id", F.sha2(F.concat_ws("|", F.lit("7"), "event_type", "user_id", "props"), 256).alias("key"))


# braces name entities here, so the JSON's own are written by their codes
@query("""SELECT event_id, chr(123) || '"fn_id":"' || event_type || '","args_digest":"' || sha256(props) || '"' || chr(125) AS key FROM {events}""", "events")
def trace_key(events):
    return events.select("event_id", F.to_json(F.struct(F.col("event_type").alias("fn_id"), F.sha2("props", 256).alias("args_digest"))).alias("key"))


@query("SELECT event_id AS seq FROM {events} e WHERE NOT EXISTS (SELECT 1 FROM {events} f WHERE f.user_id = e.user_id AND f.event_type = e.event_type AND f.ts < e.ts AND f.ts >= e.ts - INTERVAL 1 HOUR)", "events")
def single_flight(events):
    # a call shares the run of an equal one that began in the hour before: an earlier one of its own
    # clock hour is that near, so only an hour's first calls look back, at the last of the hour before
    keys = ["user_id", "event_type"]
    local = events.schema["ts"].dataType.typeName() == "timestamp_ntz"
    number = F.unix_date(F.col("ts").cast("date")) * 24 + F.hour("ts") if local else F.floor(F.unix_micros("ts") / F.lit(3_600_000_000))
    hour = number.cast("long").alias("_hour")
    hours = events.where("user_id is not null and event_type is not null and ts is not null").groupBy(*keys, hour).agg(F.min("ts").alias("ts"), F.max("ts").alias("_last"))
    before = hours.select(*keys, (F.col("_hour") + 1).alias("_hour"), F.col("_last").alias("_before"))
    first = hours.join(before, [*keys, "_hour"], "left").where("_before is null or _before < ts - interval 1 hour").select(*keys, "ts")
    nameless = events.where("user_id is null or event_type is null or ts is null")
    return events.join(first, [*keys, "ts"], "left_semi").select(F.col("event_id").alias("seq")).unionByName(nameless.select(F.col("event_id").alias("seq")))


@query("SELECT lang, source, CASE WHEN count(*) FILTER (WHERE contains(text, '&&&')) > 0 THEN 'failed' WHEN count(*) FILTER (WHERE contains(text, '!!')) > 0 THEN 'unformatted' ELSE 'clean' END AS outcome FROM {documents} GROUP BY ALL", "documents")
def fmt_attribute(documents):
    some = lambda mark: F.bool_or(F.col("text").contains(mark))
    return documents.groupBy("lang", "source").agg(F.when(some("&&&"), "failed").when(some("!!"), "unformatted").otherwise("clean").alias("outcome"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 3 THEN 'default' ELSE c_mktsegment END AS flavor FROM {customer}", "customer")
def resolve_flavor(customer):
    return customer.select("c_custkey", F.when(F.col("c_nationkey") < 3, "default").otherwise(F.col("c_mktsegment")).alias("flavor"))


@query("SELECT coalesce(p.tool, w.tool) AS tool, coalesce(p.version, w.version) AS version FROM (SELECT tool, max(version) AS version FROM {lock_new} GROUP BY tool) p FULL JOIN (SELECT tool, min(version) AS version FROM {lock} GROUP BY tool) w USING (tool)", "lock_new", "lock")
def collection_map(package, workspace):
    over = package.groupBy("tool").agg(F.max("version").alias("_over"))
    return workspace.groupBy("tool").agg(F.min("version").alias("version")).join(over, "tool", "full").select("tool", F.coalesce("_over", "version").alias("version"))


@query("SELECT p_brand AS feature, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS imports FROM {part} GROUP BY p_brand", "part")
def init_render(part):
    return part.groupBy(F.col("p_brand").alias("feature")).agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("imports"))


@query("SELECT DISTINCT address || '#' || s AS address FROM {graph_roots}, (VALUES ('crate-a'), ('crate-b')) AS c(s) WHERE is_default", "graph_roots")
def graph_synthetic(roots):
    children = F.explode(F.array(*(F.concat("address", F.lit(f"#{c}")) for c in ("crate-a", "crate-b"))))
    return roots.where("is_default").select(children.alias("address")).distinct()


@query("SELECT o_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, bool_or(l_linestatus = 'O') AS any_open FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey", "orders", "lineitem")
def pkg_analysis(orders, lineitem):
    of = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.bool_or(F.col("l_linestatus") == "O").alias("any_open"))
    return orders.select("o_orderkey").join(of, "o_orderkey")
