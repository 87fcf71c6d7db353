"""Registered queries of the retention of slots and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import retention
from graphloom.plans.build_queries import _CUT, CUTOFF, query

_KEYS = "SELECT DISTINCT lang || '/' || source AS id, CASE lang WHEN 'de' THEN {old} ELSE {new} END AS last_used FROM {{documents}} WHERE lang IN ('de', 'en')".format(old=CUTOFF - 1, new=CUTOFF)


@query(
    f"""SELECT u.id, CAST(u.last_used AS BIGINT) AS last_used, CAST(sum(size) AS BIGINT) AS bytes FROM ({_KEYS}) u JOIN {{tree_before}} ON starts_with(path, u.id || '/') WHERE u.last_used < {_CUT} GROUP BY ALL
    UNION ALL SELECT 'fr', CAST({CUTOFF - 2} AS BIGINT), CAST(sum(size) AS BIGINT) FROM {{tree_before}} WHERE starts_with(path, 'fr/') HAVING count(*) > 0""",
    "documents",
    "tree_before",
)
def gc_slots(documents, tree):
    # 'de' is recorded and old, 'en' recorded and in use, 'fr' old without record, 'es' new without record
    recorded = F.when(F.col("lang") == "de", CUTOFF - 1).otherwise(CUTOFF).cast("long").alias("last_used")
    usage = documents.where(F.col("lang").isin("de", "en")).select(F.concat_ws("/", "lang", "source").alias("id"), recorded)
    mtime = F.when(F.col("path").startswith("fr/"), CUTOFF - 2).otherwise(CUTOFF).cast("long").alias("mtime")
    return retention.expired_slots(tree.select("path", mtime, F.col("size").alias("bytes")), usage, CUTOFF)


@query(
    f"""SELECT c_nationkey AS scope, CAST(NULL AS BIGINT) AS trace FROM {{customer}} WHERE c_nationkey % 5 = 0 OR c_nationkey NOT IN (SELECT c.c_nationkey FROM {{customer}} c JOIN {{tasks}} t ON t.task = c.c_custkey) GROUP BY 1 UNION ALL
    SELECT n_nationkey + 100, NULL FROM {{nation}} UNION ALL
    SELECT c_nationkey, task FROM {{tasks}} JOIN {{customer}} ON c_custkey = task WHERE c_nationkey % 5 <> 0 AND last_used < {_CUT}""",
    "customer",
    "tasks",
    "nation",
)
def gc_traces(customer, tasks, nation):
    traces = tasks.join(customer, F.col("c_custkey") == F.col("task")).select(F.col("c_nationkey").alias("scope"), "task", F.col("last_used").alias("mtime")).withColumnRenamed("task", "trace")
    # of the scopes, those of nations have traces and paths; those from 100 on have none
    paths = customer.select(F.col("c_nationkey").alias("scope"), F.concat(F.lit("/w"), "c_nationkey").alias("path")).distinct()
    scopes = paths.unionByName(nation.select((F.col("n_nationkey") + 100).alias("scope"), F.lit(None).cast("string").alias("path")))
    existing = paths.where("scope % 5 <> 0").select("path")
    return retention.expired_traces(traces, scopes, existing, CUTOFF)
