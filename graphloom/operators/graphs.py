"""Build graphs: edges that nodes declare, walks, what a target needs, and what a scope holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans import closure


def declared_edges(nodes: DataFrame) -> DataFrame:
    """``src``, ``name``, ``dst`` of ``nodes`` (``id``, ``kind``, ``inputs``: a map of names to nodes, ``of``: one node).

    Tasks and expansions have their inputs, outputs their task, tools their artifact; other kinds are leaves.
    """
    many = nodes.where(F.col("kind").isin("task", "expansion-get", "expansion-all")).select(F.col("id").alias("src"), F.explode("inputs").alias("name", "dst")).where("dst is not null")
    name = F.when(F.col("kind") == "task-output", "task").otherwise("artifact")
    one = nodes.where(F.col("kind").isin("task-output", "tool") & F.col("of").isNotNull()).select(F.col("id").alias("src"), name.alias("name"), F.col("of").alias("dst"))
    return many.unionByName(one)


def walk(nodes: DataFrame, children: DataFrame, roots: DataFrame, discover_get: bool = False) -> DataFrame:
    """``id`` of all that ``roots`` (``id``) reach over declared edges; ``children`` (``src``, ``dst``) of expansions count where they are discovered."""
    kinds = ["expansion-all", "expansion-get"] if discover_get else ["expansion-all"]
    lazy = children.join(nodes.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")
    return closure.reachable(declared_edges(nodes).select("src", "dst").unionByName(lazy), roots)


def needed_commands(commands: DataFrame, targets: DataFrame) -> DataFrame:
    """``id``, ``wave`` of the commands that ``targets`` (``name``) need, dependencies in earlier waves.

    ``commands``: ``id`` (in the order of the file), ``outputs``, ``inputs`` (explicit, implicit and order-only).
    Of two commands with one output the later makes it. Cycles raise.
    """
    made = commands.select("id", F.explode("outputs").alias("name")).groupBy("name").agg(F.max("id").alias("id"))
    needs = commands.select(F.col("id").alias("src"), F.explode("inputs").alias("name")).join(made.withColumnRenamed("id", "dst"), "name").select("src", "dst").where("src <> dst").distinct()
    roots = targets.select("name").distinct().join(made, "name").select("id").distinct()
    found = closure.reachable(needs, roots).checkpoint()
    inside = needs.join(found.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure.levels(found, inside).withColumnRenamed("level", "wave")


def in_scopes(scopes: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``address`` of all rows of ``tables`` whose package is one of ``scopes`` (``scope``)."""
    every = None
    for table in tables:
        one = table.select("address")
        every = one if every is None else every.unionByName(one)
    package = F.substring_index("address", ":", 1).alias("scope")
    return every.where(F.col("address").contains(":")).select("address", package).join(scopes.select("scope").distinct(), "scope", "left_semi").select("address").distinct()


def changed_files(differing: DataFrame, untracked: DataFrame, prefix: str = "") -> DataFrame:
    """``path`` below the workspace, from the repository's paths that differ from a base and those it doesn't track."""
    every = differing.select("path").unionByName(untracked.select("path")).distinct()
    clean = prefix.strip("/")
    if not clean:
        return every.orderBy("path")
    return every.where(F.col("path").startswith(f"{clean}/")).select(F.substring("path", len(clean) + 2, 1 << 30).alias("path")).orderBy("path")
