"""Sets of file paths: globs, unions, ownership, and what names and paths say."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """A glob as an anchored regular expression: ``**/`` any depth, ``*`` and ``?`` within a part."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or re.escape(glob[i]))
            i += 1
    return f"^{''.join(out)}$"


def literal_prefix(glob: str) -> str:
    return re.split(r"[*?]", glob, maxsplit=1)[0]


def matches_glob(path: Column, include: list[str], exclude: list[str] = (), root: str = ".") -> Column:
    """Any of ``include`` and none of ``exclude``. Literal beginnings are tested first, as prefixes the scan can use."""
    inside = path if root == "." else F.substring(path, len(root) + 2, 1 << 30)
    under = F.lit(True) if root == "." else path.startswith(f"{root}/")
    some = lambda globs: F.lit(False) if not globs else _any([inside.startswith(literal_prefix(g)) & inside.rlike(glob_pattern(g)) for g in globs])
    return under & some(include) & ~some(exclude)


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def union(sets: list[DataFrame]) -> DataFrame:
    out = sets[0].select("path")
    for s in sets[1:]:
        out = out.unionByName(s.select("path"))
    return out.distinct()


def unowned(files: DataFrame, owned: DataFrame) -> DataFrame:
    return files.select("path").join(owned.select("path"), "path", "left_anti")


def output_slug(address: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(address, "^//", ""), "[:/]", "_")


def dist_path(address: Column) -> Column:
    package, name = F.regexp_extract(address, "^//([^:]*):", 1), F.regexp_extract(address, ":(.*)$", 1)
    return F.concat_ws("/", F.lit("dist"), F.when(package != "", package), name)


def identifier(name: Column) -> Column:
    clean = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    return F.when(clean == "", F.lit("root")).when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def worker_port(key: Column) -> Column:
    return (30000 + F.conv(F.substring(F.sha2(key, 256), 1, 4), 16, 10).cast("long") % 20000).cast("long")


def page_tree(leaves: DataFrame) -> DataFrame:
    """Leaves and their branches; a leaf that is also a branch is one row, a branch."""
    above = F.expr("transform(sequence(1, size(split(path, '/')) - 1), n -> array_join(slice(split(path, '/'), 1, n), '/'))")
    branches = leaves.where(F.size(F.split("path", "/")) > 1).select(F.explode(above).alias("path"), F.lit(True).alias("branch"))
    return leaves.select("path", F.lit(False).alias("branch")).unionByName(branches).groupBy("path").agg(F.max("branch").alias("is_branch"))
