"""What a change makes stale: input specs, recorded calls, and the packages that own changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans import closure


def prefixes(path: str = "path") -> Column:
    """All directories above a path and the path itself, shortest first."""
    return F.expr(f"transform(sequence(1, size(split({path}, '/'))), n -> array_join(slice(split({path}, '/'), 1, n), '/'))")


def touched_specs(specs: DataFrame, changed: DataFrame) -> DataFrame:
    """Specs (``spec_id``, ``kind``, ``path``) that a changed path touches: files by name, directories by anything below.

    The changed paths' own prefixes are joined by equality, so no pair of paths is compared in vain.
    """
    exact = specs.where("kind <> 'directory'").join(changed.select("path").distinct(), "path", "left_semi")
    above = changed.select(F.explode(prefixes()).alias("path")).distinct()
    inside = specs.where("kind = 'directory'").withColumn("path", F.regexp_replace("path", "/+$", ""))
    whole = inside.where("path = '.'")
    any_change = changed.select(F.lit(".").alias("path")).limit(1)
    return exact.select("spec_id").unionByName(inside.join(above, "path", "left_semi").select("spec_id")).unionByName(whole.join(any_change, "path", "left_semi").select("spec_id")).distinct()


def stale_records(records: DataFrame, current: DataFrame) -> DataFrame:
    """Keys whose recorded module digest isn't the current one; a module that is gone counts as changed."""
    now = current.select("module", F.col("digest").alias("_now"))
    return records.join(now, "module", "left").where("_now is null or _now <> digest").select("key")


def stale_closure(dependencies: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds and all that depends on them (``dependencies``: ``key`` depends on ``dep``)."""
    return closure.reachable(dependencies.select(F.col("dep").alias("src"), F.col("key").alias("dst")), seeds)


def stale_targets(targets: DataFrame, products: DataFrame, records: DataFrame, stale: DataFrame) -> DataFrame:
    """Targets of which some product has no record or a stale one; targets without products are never stale."""
    wanted = targets.join(products, "kind").select("address", "product", "tool")
    held = records.join(stale.select(F.col("id").alias("key"), F.lit(True).alias("_stale")), "key", "left")
    return wanted.join(held, ["address", "product", "tool"], "left").where("key is null or _stale").select("address").distinct()


def reasons(changes: list[tuple[str, DataFrame]]) -> DataFrame:
    """``address`` and its reasons, in the order of ``changes``."""
    rows = None
    for i, (reason, found) in enumerate(changes):
        one = found.select("address", F.struct(F.lit(i).alias("at"), F.lit(reason).alias("reason")).alias("why"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("address").agg(F.array_join(F.transform(F.array_sort(F.collect_set("why")), lambda w: w["reason"]), "; ").alias("reasons"))


#: A change to one of these concerns the whole workspace.
WORKSPACE_FILES = ("imp.workspace.js", "imp.workspace.ci.js")
BUILD_FILE = "BUILD.js"


def classes_of(changed: DataFrame, module_files: DataFrame) -> DataFrame:
    """``path`` and ``class`` of the changed paths: workspace, build, module, or null for what nothing here owns."""
    modules = module_files.select("path", F.lit(True).alias("_module")).distinct()
    name = F.when(F.col("path").isin(*WORKSPACE_FILES), "workspace").when(F.substring_index("path", "/", -1) == BUILD_FILE, "build").when(F.col("_module"), "module")
    return changed.select("path").distinct().join(modules, "path", "left").select("path", name.alias("class"))


def owners_of_change(targets: DataFrame, module_files: DataFrame, imports: DataFrame, scopes: DataFrame, changed: DataFrame) -> DataFrame:
    """``address`` of the targets (``address``) that changed paths (``path``) concern.

    A workspace file concerns every target, a build file its own package alone, a module the packages
    of all that import it, or every target if these reach a workspace file. ``module_files``: ``path``,
    ``module``; ``imports``: ``src`` imports ``dst``; ``scopes``: the package (``scope``) of a module.
    """
    classed = classes_of(changed, module_files).checkpoint()
    seeds = classed.where("class = 'module'").join(module_files, "path").select(F.col("module").alias("id"))
    reached = stale_closure(imports.select(F.col("src").alias("key"), F.col("dst").alias("dep")), seeds)
    whole = classed.where("class = 'workspace'").select("path").unionByName(reached.where(F.col("id").isin(*WORKSPACE_FILES)).select(F.col("id").alias("path")))
    if whole.limit(1).count():
        return targets.select("address").distinct()
    own = classed.where("class = 'build'").select(F.concat(F.lit("//"), F.regexp_replace("path", "/?[^/]*$", "")).alias("_scope"))
    above = scopes.join(reached.withColumnRenamed("id", "module"), "module").where(~F.col("scope").isNull()).select(F.col("scope").alias("_scope"))
    wanted = own.unionByName(above).distinct()
    return targets.select("address", F.substring_index("address", ":", 1).alias("_scope")).join(wanted, "_scope", "left_semi").select("address").distinct()
