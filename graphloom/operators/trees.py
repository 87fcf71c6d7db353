"""Content-addressed file trees as relations: one row per path, with digest and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def with_directories(tree: DataFrame) -> DataFrame:
    """``path``, ``kind`` (file or dir), ``digest``, ``size``: the files and every directory above them."""
    parts = F.split("path", "/")
    above = F.expr("transform(sequence(1, size(split(path, '/')) - 1), n -> array_join(slice(split(path, '/'), 1, n), '/'))")
    dirs = tree.where(F.size(parts) > 1).select(F.explode(above).alias("path")).distinct()
    files = tree.select("path", F.lit("file").alias("kind"), "digest", "size")
    return files.unionByName(dirs.select("path", F.lit("dir").alias("kind"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("size")))


def merge(trees: list[DataFrame]) -> DataFrame:
    """The union of trees; of equal files the first tree's row stays. Different contents of a path raise, as does a file that is a directory elsewhere."""
    rows = None
    for i, tree in enumerate(trees):
        one = tree.select("path", "digest", "size", F.lit(i).alias("_at"))
        rows = one if rows is None else rows.unionByName(one)
    # a file that another tree has files under meets them at its own path; only files have digests
    above = F.expr("transform(sequence(1, size(split(path, '/')) - 1), n -> array_join(slice(split(path, '/'), 1, n), '/'))")
    under = rows.where(F.size(F.split("path", "/")) > 1).select(F.explode(above).alias("path")).distinct()
    every = rows.unionByName(under.select("path", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("size"), F.lit(-1).alias("_at")))
    held = F.col("_at") >= 0
    merged = every.groupBy("path").agg(F.min_by(F.struct("digest", "size"), F.when(held, F.col("_at"))).alias("x"), F.count_distinct("digest").alias("_n"), F.bool_or(held).alias("_file"), F.bool_or(~held).alias("_dir"))
    wrong = (F.col("_n") > 1) | F.col("_dir")
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("the trees differ at "), F.col("path")))).otherwise(F.col("x"))
    return merged.where("_file").withColumn("x", checked).select("path", "x.digest", "x.size")


def conflicts(trees: list[DataFrame]) -> DataFrame:
    """Paths with different contents, or that are a file here and a directory there."""
    rows = None
    for tree in trees:
        one = with_directories(tree).select("path", "kind", "digest")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("path").agg(F.count_distinct("kind").alias("kinds"), F.count_distinct("digest").alias("contents")).where("kinds > 1 or contents > 1").select("path")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path``, ``change``; a directory that is wholly new or gone is one row.

    A row counts only if its parent is a directory in both trees, or the root.
    """
    old, new = with_directories(before), with_directories(after)
    both = old.select("path", F.col("kind").alias("a"), F.col("digest").alias("x")).join(new.select("path", F.col("kind").alias("b"), F.col("digest").alias("y")), "path", "full")
    changed = both.where("not (a <=> b and x <=> y)").withColumn("change", F.expr("CASE WHEN a IS NULL THEN 'Added' WHEN b IS NULL THEN 'Removed' ELSE 'Modified' END"))
    shared = old.where("kind = 'dir'").select("path").intersect(new.where("kind = 'dir'").select("path")).withColumnRenamed("path", "_dir")
    rows = changed.select("path", "change", parent(F.col("path")).alias("_dir"))
    return rows.where("_dir = ''").unionByName(rows.join(shared, "_dir", "left_semi").select("path", "change", "_dir")).select("path", "change")


def digests(tree: DataFrame) -> DataFrame:
    """``path``, ``digest`` of every directory (the root's path is empty), from the leaves upward.

    A directory's digest is the SHA-256 of its sorted entries (name, kind, digest), so equal contents have equal
    digests wherever they lie. One pass for each depth; the entries of a level are grouped by directory.
    """
    level = tree.select("path", F.lit("file").alias("kind"), "digest")
    deepest = level.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    found = None
    for depth in range(deepest, 0, -1):
        entries = level.where(F.size(F.split("path", "/")) == depth)
        entry = F.struct(F.substring_index("path", "/", -1).alias("name"), "kind", "digest")
        of = entries.groupBy(parent(F.col("path")).alias("path")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(entry))), 256).alias("digest")).checkpoint()
        found = of if found is None else found.unionByName(of)
        level = level.where(F.size(F.split("path", "/")) < depth).unionByName(of.select("path", F.lit("dir").alias("kind"), "digest"))
    return found if found is not None else tree.select("path", "digest").limit(0)


def listing(tree: DataFrame) -> DataFrame:
    """Paths with their place in per-level byte order (``a/b`` before ``a.txt``)."""
    return tree.select("path", F.split("path", "/").alias("parts")).orderBy("parts").select("path")


def below(tree: DataFrame, prefix: str) -> DataFrame:
    """What lies under a directory, named from there; the empty prefix is the root."""
    clean = "/".join(p for p in prefix.split("/") if p)
    if not clean:
        return tree
    return tree.where(F.col("path").startswith(f"{clean}/")).withColumn("path", F.substring("path", len(clean) + 2, 1 << 30))


def stat(tree: DataFrame, prefix: str = "") -> DataFrame:
    return below(tree, prefix).agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def nest(tree: DataFrame, prefix: str) -> DataFrame:
    return tree.withColumn("path", F.concat(F.lit(f"{prefix}/"), "path"))


def artifact_path(path: Column) -> Column:
    """A relative path without ``.`` parts; null if it is empty, absolute, or has ``..``."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    bad = path.startswith("/") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))
