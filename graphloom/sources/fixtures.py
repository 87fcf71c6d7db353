"""The build-graph entities, derived from the star-schema tables by rules that both engines share.

``RULES`` holds one SELECT per entity; ``{name}`` stands for a table or another entity. Spark reads
it with DataFrames bound to the names, the oracle as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "conversations", "pages")

_PLACE = "lower(replace(r_name, ' ', '_')) || '/' || lower(replace(n_name, ' ', '_'))"
RULES = {
    "targets": f"SELECT '//' || {_PLACE} || ':cust' || c_custkey AS address, {_PLACE} AS package, c_mktsegment AS kind, c_custkey AS id FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey",
    "products": "SELECT * FROM (VALUES ('BUILDING', 'build', 'gcc'), ('BUILDING', 'build', 'zig'), ('AUTOMOBILE', 'build', 'gcc'), ('AUTOMOBILE', 'test', 'gcc'), ('MACHINERY', 'test', 'uv')) AS t(kind, product, tool)",
    "labels": f"SELECT '//' || {_PLACE} || '/suppliers:s' || s_suppkey AS address, {_PLACE} || '/suppliers' AS package, s_suppkey AS id, true AS is_primary FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey UNION ALL SELECT '//alias:s' || s_suppkey, 'alias', s_suppkey, false FROM {{supplier}} WHERE s_suppkey % 5 = 0",
    "handlers": "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'build' ELSE 'test' END AS goal FROM {supplier} WHERE s_suppkey % 3 < 2",
    "graph_roots": "SELECT '//parts/' || lower(replace(p_type, ' ', '_')) || CASE WHEN p_partkey % 50 = 0 THEN '' ELSE ':p' || p_partkey END AS address, CASE p_size % 2 WHEN 0 THEN 'build' ELSE 'test' END AS workflow, CASE p_size % 3 WHEN 1 THEN 'unit' WHEN 2 THEN 'asan' END AS facet, p_partkey AS handle_id, p_partkey % 50 = 0 AS is_default FROM {part}",
    "imports": "SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS src, p_partkey AS dst FROM {part} WHERE p_partkey >= 1 UNION ALL SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT)",
    "replies": "SELECT conv_id * 1000 + turn AS src, conv_id * 1000 + turn - 1 AS dst FROM {conversations} WHERE turn > 0",
    "order_edges": "SELECT DISTINCT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM {lineitem} UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM {orders}",
    "cc_edges": "SELECT src, dst FROM {order_edges} UNION ALL SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey FROM {lineitem}",
    "tree_before": "SELECT lang || '/' || source || '/' || doc_id AS path, SHA(text) AS digest, OCTETS(text) AS size FROM {documents} WHERE doc_id % 11 <> 0",
    "tree_after": "SELECT lang || '/' || source || '/' || doc_id AS path, SHA(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS digest, OCTETS(text) AS size FROM {documents} WHERE NOT (lang = 'es' AND source = 'src3')",
    "blobs": "SELECT doc_id AS seq, SHA(text) AS digest, 'doc-' || lang AS kind, OCTETS(text) AS bytes FROM {documents}",
    "remote": "SELECT SHA(text) AS digest FROM {documents} WHERE doc_id % 3 = 0 UNION SELECT SHA(text) FROM {benchmark}",
    "usage_events": "SELECT event_id AS seq, event_type AS kind, user_id AS id, EPOCH(ts) AS moment, CASE WHEN event_id % 4 = 0 THEN CAST(floor(value * 100) AS BIGINT) END AS size_bytes FROM {events}",
    "tasks": "SELECT o_custkey AS task, max(EPOCH(o_orderdate)) AS last_used FROM {orders} GROUP BY o_custkey",
    "task_blobs": "SELECT o_custkey AS task, o_orderkey AS blob, EPOCH(o_orderdate) AS last_used, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM {orders}",
    "task_events": "SELECT event_id AS seq, user_id AS id, EPOCH(ts) AS moment, CASE event_type WHEN 'signup' THEN 'Pending' WHEN 'view' THEN 'Running' WHEN 'purchase' THEN 'Done' WHEN 'error' THEN 'Done' ELSE 'Lane' END AS event, CASE event_type WHEN 'purchase' THEN 'Ok' WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'Canceled' ELSE 'Err' END END AS outcome, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS cached, CASE event_id % 2 WHEN 0 THEN 'local' ELSE 'remote' END AS cache_source, user_id % 4 AS slot FROM {events}",
    "lock": "SELECT p_brand AS tool, p_type AS version, p_size AS platform, max(p_partkey) AS url FROM {part} GROUP BY p_brand, p_type, p_size",
    "lock_new": "SELECT p_brand AS tool, p_type AS version, p_size AS platform, max(p_partkey) AS url FROM {part} WHERE p_partkey % 7 = 0 GROUP BY p_brand, p_type, p_size",
}

_DIALECTS = {
    "spark": {"SHA": r"sha2(\1, 256)", "OCTETS": r"CAST(octet_length(\1) AS BIGINT)", "EPOCH": r"unix_timestamp(CAST(\1 AS TIMESTAMP))"},
    "duckdb": {"SHA": r"sha256(\1)", "OCTETS": r"CAST(strlen(\1) AS BIGINT)", "EPOCH": r"CAST(floor(epoch(\1)) AS BIGINT)"},
}
_CALL = r"\b{}\(((?:[^()]|\([^()]*\))*)\)"


def dialect(sql: str, engine: str) -> str:
    for name, form in _DIALECTS[engine].items():
        sql = re.sub(_CALL.format(name), form, sql)
    return sql


def read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Tables or entities by name; only the tables that a rule names are read."""
    return [_read(spark, sf_dir, name) for name in names]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rule = dialect(RULES[name], "spark")
    return spark.sql(rule, **{of: _read(spark, sf_dir, of) for of in set(re.findall(r"\{(\w+)\}", rule))})


def oracle(sql: str) -> str:
    """``sql`` for DuckDB, with the entities that it names in braces."""
    ctes: dict[str, str] = {}

    def need(of: str) -> None:
        for name in re.findall(r"\{(\w+)\}", of):
            if name in RULES and name not in ctes:
                need(RULES[name])
                ctes[name] = RULES[name]

    need(sql)
    recursive = sql.lstrip().upper().startswith("WITH RECURSIVE")
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql, flags=re.IGNORECASE) if re.match(r"\s*WITH\b", sql, re.IGNORECASE) else None
    heads = ", ".join(f"{n} AS ({r})" for n, r in ctes.items())
    whole = f"WITH {'RECURSIVE ' if recursive else ''}{heads}{', ' if heads and body else ''}{body if body else ' ' + sql}" if heads or body else sql
    return re.sub(r"\{(\w+)\}", r"\1", dialect(whole, "duckdb"))
