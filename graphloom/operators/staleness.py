"""Recorded inputs against what has changed: files, folders, file sets and configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.changes import prefixes, touched_specs


def glob_regex(glob: Column) -> Column:
    """A column of globs as anchored regular expressions: ``**/`` any depth, ``*`` and ``?`` within a part."""
    out = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1")
    # marks stand for the wildcards while the shorter ones are replaced
    for wild, mark in (("**/", "\x01"), ("**", "\x02"), ("*", "\x03"), ("?", "\x04")):
        out = F.replace(out, F.lit(wild), F.lit(mark))
    for mark, form in (("\x01", "(?:.*/)?"), ("\x02", ".*"), ("\x03", "[^/]*"), ("\x04", "[^/]")):
        out = F.replace(out, F.lit(mark), F.lit(form))
    return F.concat(F.lit("^"), out, F.lit("$"))


def touched_filesets(filesets: DataFrame, changed: DataFrame) -> DataFrame:
    """``key``, ``path`` of changed paths that a file set covers.

    ``filesets``: ``key``, ``root`` (``.`` is the workspace), ``include`` and ``exclude`` globs from there,
    ``paths`` taken literally; several rows of a key are its union. Changed paths meet roots by equality with
    the folders above them, never pair by pair.
    """
    paths = changed.select("path").distinct()
    literal = filesets.select("key", F.explode("paths").alias("path")).join(paths, "path", "left_semi").select("key", "path")
    above = paths.select("path", F.explode(F.concat(F.array(F.lit(".")), prefixes())).alias("root"))
    met = filesets.where(F.size("include") > 0).join(above, "root")
    inside = F.when(F.col("root") == ".", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
    some = lambda globs: F.exists(globs, lambda g: F.regexp_like(F.col("inside"), glob_regex(g)))
    globbed = met.withColumn("inside", inside).where(some("include") & ~F.coalesce(some("exclude"), F.lit(False))).select("key", "path")
    return literal.unionByName(globbed).distinct()


def namespace_digest(keys: DataFrame, config: DataFrame) -> DataFrame:
    """``key``, ``digest`` of the settings (``namespace``, ``value``) of each key's ``namespaces``; absent ones count as null."""
    rows = keys.select("key", F.explode(F.array_distinct("namespaces")).alias("namespace")).join(config, "namespace", "left")
    line = F.to_json(F.array_sort(F.collect_list(F.struct("namespace", F.coalesce("value", F.lit("null")).alias("value")))))
    found = rows.groupBy("key").agg(F.sha2(line, 256).alias("digest"))
    empty = keys.where(F.size("namespaces") == 0).select("key", F.sha2(F.lit("[]"), 256).alias("digest"))
    return found.unionByName(empty)


def stale_config(specs: DataFrame, config: DataFrame) -> DataFrame:
    """``key`` of specs (``key``, ``spec``: a JSON list of namespaces, ``digest``) whose settings changed; malformed or without digest: stale."""
    rows = specs.select("key", F.from_json("spec", "array<string>").alias("namespaces"), F.col("digest").alias("recorded"))
    sound = rows.where("namespaces is not null and recorded is not null")
    now = namespace_digest(sound, config)
    changed = sound.join(now, "key").where("digest <> recorded").select("key")
    return rows.where("namespaces is null or recorded is null").select("key").unionByName(changed).distinct()


def stale_inputs(specs: DataFrame, changed: DataFrame, config: DataFrame) -> DataFrame:
    """``key`` of records with a stale input. ``specs``: ``key``, ``kind``, ``spec`` (JSON), ``digest``; unknown kinds are fresh."""
    of = lambda kind: specs.where(F.col("kind") == kind)
    at = lambda place: F.get_json_object("spec", place)
    files = of("read_file").select("key", at("$").alias("path")).join(changed.select("path").distinct(), "path", "left_semi").select("key")
    inputs = touched_specs(of("run_input").select(F.col("key").alias("spec_id"), at("$.kind").alias("kind"), at("$.path").alias("path")).where("path is not null"), changed).select(F.col("spec_id").alias("key"))
    shape = "root string, include array<string>, exclude array<string>, paths array<string>, `union` array<struct<root: string, include: array<string>, exclude: array<string>, paths: array<string>>>"
    sets = of("fileset").select("key", F.from_json("spec", shape).alias("s"))
    parts = sets.select("key", F.explode(F.concat(F.array(F.struct("s.root", "s.include", "s.exclude", "s.paths")), F.coalesce("s.union", F.array().cast("array<struct<root: string, include: array<string>, exclude: array<string>, paths: array<string>>>")))).alias("p"))
    none = F.array().cast("array<string>")
    flat = parts.select("key", F.coalesce("p.root", F.lit(".")).alias("root"), *(F.coalesce(f"p.{c}", none).alias(c) for c in ("include", "exclude", "paths")))
    filesets = touched_filesets(flat, changed).select("key")
    return files.unionByName(inputs).unionByName(filesets).unionByName(stale_config(of("config_namespaces"), config)).distinct()


def missing_inputs(declared: DataFrame, recorded: DataFrame) -> DataFrame:
    """Declared run inputs (``key``, ``path``) that a record lacks; any makes the record invalid."""
    return declared.select("key", "path").distinct().join(recorded.select("key", "path"), ["key", "path"], "left_anti")


def trace_records(lines: DataFrame) -> DataFrame:
    """``key``, ``fn_id`` of the JSON ``line`` records of version 1; anything else is skipped."""
    parsed = lines.select(F.from_json("line", "version int, key string, fn_id string").alias("r"))
    return parsed.select("r.*").where("version = 1 and key is not null and fn_id is not null").select("key", "fn_id")


def records_of(records: DataFrame, fn_id: str) -> DataFrame:
    return records.where(F.col("fn_id") == fn_id).orderBy("key")
