"""Packages by their sources and imports: where they lie, what they import, whose a manifest is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(base: Column, path: Column) -> Column:
    """``base/path`` from the workspace root without empty, ``.`` and ``..`` parts; ``.`` is the root. Leaving the root raises."""
    whole = F.concat(F.coalesce(base, F.lit(".")), F.lit("/"), F.coalesce(path, F.lit(".")))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        kept = F.when(part.isin("", "."), acc["kept"]).when(up, F.slice(acc["kept"], 1, F.greatest(F.size(acc["kept"]) - 1, F.lit(0)))).otherwise(F.concat(acc["kept"], F.array(part)))
        return F.struct(kept.alias("kept"), (acc["out"] | (up & (F.size(acc["kept"]) == 0))).alias("out"))

    def end(acc: Column) -> Column:
        clean = F.when(F.size(acc["kept"]) == 0, F.lit(".")).otherwise(F.array_join(acc["kept"], "/"))
        return F.when(acc["out"], F.raise_error(F.concat(F.lit("the path leaves the workspace: "), whole))).otherwise(clean)

    return F.aggregate(F.split(whole, "/"), start, step, end)


def resolved(imports: DataFrame, collections: DataFrame) -> DataFrame:
    """``imports`` (``package``, ``path`` of the package, ``import``) with ``target``: the folder that each names.

    ``name:rest`` lies in a collection (``name``, ``root``), null if there is none; anything else is relative.
    """
    at = F.instr("import", ":")
    name = F.when(at > 1, F.expr("substring(import, 1, instr(import, ':') - 1)"))
    rows = imports.withColumn("_name", name).join(collections.select(F.col("name").alias("_name"), F.col("root").alias("_root")), "_name", "left")
    named = F.when(F.col("_root").isNotNull(), joined(F.col("_root"), F.expr("substring(import, instr(import, ':') + 1)")))
    return rows.withColumn("target", F.when(at == 0, joined(F.col("path"), F.col("import"))).otherwise(named)).select(*imports.columns, "target")


def scanned(code: Column) -> Column:
    """Of sources whose comments are blanked: ``imports`` and ``collections`` (distinct, sorted), and whether a main procedure is there.

    An import is ``import`` with a quoted path, alone or with a name, or a line of a parenthesised block.
    """
    single = F.regexp_extract_all(code, F.lit(r'(?m)^[ \t]*import[ \t]+(?:[A-Za-z_$][\w$]*[ \t]+)?"([^"]+)"'), 1)
    blocks = F.regexp_extract_all(code, F.lit(r"(?m)^[ \t]*import[ \t]*\(([^)]*)\)"), 1)
    inner = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r'"([^"]+)"'), 1)))
    imports = F.array_sort(F.array_distinct(F.concat(single, inner)))
    names = F.transform(F.filter(imports, lambda i: F.instr(i, ":") > 1), lambda i: F.substring_index(i, ":", 1))
    main = F.regexp_like(code, F.lit(r"(?m)^\s*main\s*::\s*proc\s*\("))
    return F.struct(imports.alias("imports"), F.array_sort(F.array_distinct(names)).alias("collections"), main.alias("has_main"))


def inferred_paths(packages: DataFrame, sources: DataFrame) -> DataFrame:
    """``package``, ``path``: the declared folder if a source lies there or there are none, else the only one. Several raise."""
    folder = F.when(F.col("source").contains("/"), F.regexp_replace("source", "/[^/]*$", "")).otherwise(".")
    found = sources.select("package", folder.alias("_folder")).join(packages.select("package", "declared"), "package").groupBy("package").agg(
        F.bool_or(F.col("_folder") == F.col("declared")).alias("_here"), F.count_distinct("_folder").alias("_n"), F.min("_folder").alias("_one")
    )
    spread = F.raise_error(F.concat(F.lit("sources lie in several folders of "), F.col("package")))
    path = F.when(F.col("_n").isNull() | F.col("_here"), F.col("declared")).when(F.col("_n") == 1, F.col("_one")).otherwise(spread)
    return packages.join(found, "package", "left").select("package", path.alias("path"))


def dependencies(targets: DataFrame, packages: DataFrame, explicit: DataFrame) -> DataFrame:
    """``package``, ``dep``: what imports (``package``, ``target``) resolve to, and the explicit ones. Itself never counts; two candidates raise."""
    index = packages.select(F.col("path").alias("target"), F.col("package").alias("_dep"))
    met = targets.where("target is not null").select("package", "target").distinct().join(index, "target").where("_dep <> package")
    many = F.raise_error(F.concat(F.lit("an import resolves to several packages: "), F.col("target")))
    found = met.groupBy("package", "target").agg(F.count("*").alias("_n"), F.min("_dep").alias("_one")).select("package", F.when(F.col("_n") > 1, many).otherwise(F.col("_one")).alias("dep"))
    return explicit.select("package", "dep").unionByName(found).distinct()


def of_manifests(manifests: DataFrame, members: DataFrame, root: str) -> DataFrame:
    """``manifest``, ``name`` of the first member (by ``seq``) whose ``manifest_path`` ends with it; the root's must be whole.

    A manifest is met by equality with the tails of the members' paths, so no pair is compared.
    """
    tails = F.expr("transform(sequence(1, size(split(manifest_path, '/'))), n -> array_join(slice(split(manifest_path, '/'), n, size(split(manifest_path, '/'))), '/'))")
    whole = F.concat(F.lit(root.rstrip("/")), F.lit("/Cargo.toml"))
    # the whole path is no tail of itself, and the root's manifest is only met as a whole
    below = members.select("name", "seq", "manifest_path", F.explode(tails).alias("manifest")).where("manifest <> manifest_path and manifest <> 'Cargo.toml'").select("name", "seq", "manifest")
    top = members.where(F.col("manifest_path") == whole).select("name", "seq", F.lit("Cargo.toml").alias("manifest"))
    first = below.unionByName(top).groupBy("manifest").agg(F.min_by("name", "seq").alias("name"))
    return manifests.select("manifest").distinct().join(first, "manifest", "left")
