"""Fixpoints over edge tables: reachability, levels and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.multiplicity import multiplicity  # noqa: F401
from graphloom.sources.session import ensure_checkpoints


#: So many levels' files are read side by side before they are put together.
COMPACT = 16


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reachable(edges: DataFrame, seeds: DataFrame, most_levels: int = 10_000) -> DataFrame:
    """``id`` of all nodes that ``seeds`` (``id``) reach over ``edges`` (``src``, ``dst``), seeds included.

    Each level joins the frontier with the edges, drops what is known, and is checkpointed once; what
    is known is the list of levels, put together every ``COMPACT`` of them. So neither lineage nor plan
    grows, and a node is written a few times at most. Cycles end because known nodes never return.
    """
    ensure_checkpoints(edges.sparkSession)
    frontier = seeds.select("id").distinct().checkpoint()
    seen = [frontier]
    for _ in range(most_levels):
        step = edges.join(frontier.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        frontier = step.join(_all(seen), "id", "left_anti").checkpoint()
        if frontier.isEmpty():
            return _all(seen)
        seen.append(frontier)
        if len(seen) >= COMPACT:
            seen = [_all(seen).checkpoint()]
    raise ValueError(f"no fixpoint after {most_levels} levels")


def depths(edges: DataFrame, seeds: DataFrame, most_levels: int = 10_000) -> DataFrame:
    """``id``, ``depth`` of all that ``seeds`` reach: the length of the shortest way, a batch for each depth."""
    ensure_checkpoints(edges.sparkSession)
    frontier = seeds.select("id").distinct().withColumn("depth", F.lit(0)).checkpoint()
    seen = [frontier]
    for depth in range(1, most_levels):
        step = edges.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = step.join(_all(seen), "id", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if frontier.isEmpty():
            return _all(seen)
        seen.append(frontier)
        if len(seen) >= COMPACT:
            seen = [_all(seen).checkpoint()]
    raise ValueError(f"no fixpoint after {most_levels} levels")


def levels(nodes: DataFrame, edges: DataFrame, most_levels: int = 10_000) -> DataFrame:
    """``id``, ``level``: the longest path to each node (``dst`` depends on ``src``). Cycles raise.

    Only the nodes whose level rose are followed on. No path without a cycle has more edges than there
    are nodes, so a level beyond their number ends it.
    """
    ensure_checkpoints(edges.sparkSession)
    known = nodes.select("id").distinct().withColumn("level", F.lit(0)).checkpoint()
    raised = known
    for _ in range(min(most_levels, known.count()) + 1):
        step = edges.join(raised.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg((F.max("level") + 1).alias("new"))
        raised = known.join(step, "id").where("new > level").select("id", F.col("new").alias("level")).checkpoint()
        if raised.isEmpty():
            return known
        known = known.join(raised.withColumnRenamed("level", "new"), "id", "left").select("id", F.coalesce("new", "level").alias("level")).checkpoint()
    raise ValueError("the graph has a cycle")


def peeled(edges: DataFrame, most_levels: int = 10_000) -> DataFrame:
    """The edges left when nodes without successors and nodes without predecessors are taken away again and again."""
    left = edges.select("src", "dst").distinct().checkpoint()
    n = left.count()
    for _ in range(most_levels):
        ends, starts = left.select(F.col("src").alias("dst")).distinct(), left.select(F.col("dst").alias("src")).distinct()
        left = left.join(ends, "dst", "left_semi").join(starts, "src", "left_semi").checkpoint()
        m = left.count()
        if m == n:
            return left
        n = m
    raise ValueError(f"no fixpoint after {most_levels} levels")


def _smallest_before(edges: DataFrame, most_levels: int) -> DataFrame:
    """``id``, ``least``: the smallest node that reaches each node (itself included)."""
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    known = ids.withColumn("least", F.col("id")).checkpoint()
    raised = known
    for _ in range(most_levels):
        step = edges.join(raised.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("least").alias("new"))
        raised = known.join(step, "id").where("new < least").select("id", F.col("new").alias("least")).checkpoint()
        if raised.isEmpty():
            return known
        known = known.join(raised.withColumnRenamed("least", "new"), "id", "left").select("id", F.coalesce("new", "least").alias("least")).checkpoint()
    raise ValueError(f"no fixpoint after {most_levels} levels")


def on_cycles(edges: DataFrame, most_levels: int = 10_000) -> DataFrame:
    """``id`` of the nodes that lie on a cycle, by coloring: forward, each node takes the smallest that reaches it;
    of the nodes of one color, those that reach its root backward are a component. Nodes between cycles don't count.

    A component of two nodes or more, or a node with an edge to itself, is on a cycle. What was decided is taken away and
    the rest peeled and colored again.
    """
    ensure_checkpoints(edges.sparkSession)
    own = edges.where("src = dst").select(F.col("src").alias("id")).distinct().checkpoint()
    left, found = peeled(edges.where("src <> dst"), most_levels), [own]
    for _ in range(most_levels):
        if left.isEmpty():
            return _all(found).distinct()
        color = _smallest_before(left, most_levels)
        of = lambda end, color=color: color.select(F.col("id").alias(end), F.col("least").alias(f"color_{end}"))
        inside = left.join(of("src"), "src").join(of("dst"), "dst").where("color_src = color_dst").select("src", "dst").checkpoint()
        back = reachable(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), color.select(F.col("least").alias("id")).distinct(), most_levels).checkpoint()
        # a root alone in its component has no edge of its color that leads back to it
        some = inside.join(back.withColumnRenamed("id", "src"), "src", "left_semi").join(back.withColumnRenamed("id", "dst"), "dst", "left_semi")
        part = some.select(F.col("src").alias("id")).intersect(some.select(F.col("dst").alias("id"))).checkpoint()
        found.append(part)
        gone = back
        left = peeled(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"), most_levels)
    raise ValueError(f"no fixpoint after {most_levels} levels")
