"""Retention of slots (named folders with their own use records) and of call traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PREFIXES = "transform(sequence(1, size(split(path, '/'))), n -> array_join(slice(split(path, '/'), 1, n), '/'))"


def expired_slots(entries: DataFrame, usage: DataFrame, cutoff: int) -> DataFrame:
    """``id``, ``last_used``, ``bytes`` of slots to drop, from ``entries`` (``path``, ``mtime``, ``bytes``) and ``usage`` (``id``, ``last_used``).

    A recorded slot goes if it exists and was last used before the cutoff. A top-level child without any
    record in or above it goes if the newest entry inside is older than the cutoff. Null paths take no part.

    Each entry is matched by equality with the folders above it, so no pair of all entries and slots arises,
    and sizes are summed before the shuffle.
    """
    known = usage.where("id is not null").groupBy("id").agg(F.max("last_used").alias("last_used"))
    inside = entries.where("path is not null").select(F.explode(F.expr(_PREFIXES)).alias("id"), "mtime", "bytes")
    folders = inside.groupBy("id").agg(F.max("mtime").alias("_mtime"), F.sum("bytes").alias("bytes"))
    recorded = known.where(F.col("last_used") < cutoff).join(folders, "id").select("id", "last_used", "bytes")
    covered = known.select(F.split_part("id", F.lit("/"), F.lit(1)).alias("id")).distinct()
    other = folders.where(~F.col("id").contains("/") & (F.col("_mtime") < cutoff)).join(covered, "id", "left_anti")
    return recorded.unionByName(other.select("id", F.col("_mtime").alias("last_used"), "bytes"))


def expired_traces(traces: DataFrame, scopes: DataFrame, existing: DataFrame, cutoff: int) -> DataFrame:
    """``scope``, ``trace`` to drop; ``trace`` is null where a whole scope goes.

    A scope of ``scopes`` (``scope``, ``path``) goes if its recorded path isn't in ``existing`` (``path``) or no trace
    lies in it; of the other scopes go the ``traces`` (``scope``, ``trace``, ``mtime``) from before the cutoff. A scope
    whose path is null was never recorded and hasn't vanished.
    """
    vanished = scopes.where("path is not null").join(existing.select("path"), "path", "left_anti").select("scope")
    empty = scopes.select("scope").join(traces.select("scope"), "scope", "left_anti")
    whole = vanished.unionByName(empty).distinct()
    old = traces.where(F.col("mtime") < cutoff).select("scope", "trace").join(whole, "scope", "left_anti")
    return whole.select("scope", F.lit(None).cast(traces.schema["trace"].dataType).alias("trace")).unionByName(old)
