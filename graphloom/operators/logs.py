"""What tools print: JSON lines of builds, and which targets their messages concern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE = "reason string, executable string, target struct<name: string, kind: array<string>>, profile struct<test: boolean>, message struct<level: string, rendered: string, spans: array<struct<file_name: string>>>"


def _lines(output: DataFrame, keys: list[str]) -> DataFrame:
    """The JSON objects of each output (``stdout``), in order; other lines are skipped."""
    lines = output.select(*keys, F.posexplode(F.split("stdout", "\n")).alias("seq", "_line"))
    return lines.select(*keys, "seq", F.from_json("_line", _LINE).alias("r")).where("r.reason is not null").select(*keys, "seq", "r.*")


def test_binaries(output: DataFrame, keys: list[str], build_dir: str) -> DataFrame:
    """``keys``, ``name``, ``kind`` (the first, or ``test``), ``path`` of the test executables that a build reports.

    A path is taken from the build folder's first occurrence on, or as it is.
    """
    rows = _lines(output, keys).where("reason = 'compiler-artifact' and executable is not null and profile.test")
    at = F.instr("executable", build_dir)
    path = F.when(at > 0, F.expr(f"substring(executable, instr(executable, '{build_dir}'))")).otherwise(F.col("executable"))
    return rows.select(*keys, F.col("target.name").alias("name"), F.coalesce(F.try_element_at("target.kind", F.lit(1)), F.lit("test")).alias("kind"), path.alias("path"))


def lint_verdicts(output: DataFrame, members: DataFrame, key: str, failed: DataFrame) -> DataFrame:
    """``key``, ``member``, ``messages``, ``fails`` for each member (``key``, ``member``, ``dir``) of a run.

    A compiler message concerns the members whose folder is in its path; they fail on a warning or an error.
    A run that failed (``failed``: ``key``) with no such message for anybody fails all its members.
    """
    told = _lines(output, [key]).where("reason = 'compiler-message' and message.rendered is not null")
    paths = told.select(key, "seq", F.col("message.level").alias("level"), F.explode("message.spans").alias("s")).select(key, "seq", "level", F.concat(F.lit("/"), "s.file_name").alias("path"))
    # a path's folders meet the members' by equality
    above = F.explode(F.expr("transform(sequence(1, size(split(path, '/')) - 1), n -> array_join(slice(split(path, '/'), 2, n - 1), '/'))")).alias("dir")
    met = paths.select(key, "seq", "level", above).distinct().join(members, [key, "dir"])
    each = met.groupBy(key, "member").agg(F.count_distinct("seq").alias("messages"), F.bool_or(F.col("level").isin("warning", "error")).alias("_bad"))
    blamed = each.groupBy(key).agg(F.bool_or("_bad").alias("_some"))
    rows = members.select(key, "member").distinct().join(each, [key, "member"], "left").join(blamed, key, "left").join(failed.select(key, F.lit(True).alias("_failed")).distinct(), key, "left")
    whole = F.coalesce("_failed", F.lit(False)) & ~F.coalesce("_some", F.lit(False))
    return rows.select(key, "member", F.coalesce("messages", F.lit(0)).alias("messages"), (F.coalesce("_bad", F.lit(False)) | whole).alias("fails"))
