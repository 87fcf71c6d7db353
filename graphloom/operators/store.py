"""The content-addressed store: de-duplication, cache hits, missing blobs, retention and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CATEGORIES = ("tasks", "blobs")


def first_written(blobs: DataFrame) -> DataFrame:
    """One row per digest: the first writer's kind and size stay. Aggregated before any shuffle."""
    return blobs.groupBy("digest").agg(F.min_by(F.struct("kind", "bytes"), "seq").alias("x")).select("digest", "x.kind", "x.bytes")


def missing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Distinct digests of ``wanted`` that ``present`` lacks."""
    return wanted.select("digest").distinct().join(present.select("digest"), "digest", "left_anti")


def read_status(wanted: DataFrame, present: DataFrame) -> DataFrame:
    held = present.select("digest").distinct().withColumn("_held", F.lit(True))
    return wanted.select("digest").distinct().join(held, "digest", "left").select("digest", F.when(F.col("_held"), "ok").otherwise("missing").alias("status"))


def hits(calls: DataFrame, keys: list[str], keep_first: bool = False) -> DataFrame:
    """Calls and whether each is the first of its key (miss) or a later one (hit); with ``keep_first``, that first's ``seq`` as ``_first``.

    The first of each key comes from an aggregate and a join that can split hot keys.
    """
    first = calls.groupBy(*keys).agg(F.min("seq").alias("_first")).select(F.col("_first"), *(F.col(k).alias(f"_first_{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        # equal nulls are one key
        same = same & F.col(k).eqNullSafe(F.col(f"_first_{k}"))
    return calls.join(first, same).withColumn("result", F.when(F.col("seq") == F.col("_first"), "miss").otherwise("hit")).drop(*([] if keep_first else ["_first"]), *(f"_first_{k}" for k in keys))


def upsert(events: DataFrame) -> DataFrame:
    """Usage rows after all events: creation kept, last use raised, a size never cleared by an unsized event."""
    return events.groupBy("kind", "id").agg(
        F.min("moment").alias("created_at"), F.max("moment").alias("last_used_at"), F.max_by("size_bytes", F.when(F.col("size_bytes").isNotNull(), F.struct("moment", "seq"))).alias("size_bytes")
    )


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def live(tasks: DataFrame, cutoff: int) -> DataFrame:
    return tasks.where(F.coalesce("last_used", F.lit(0)) >= cutoff)


def expired(tasks: DataFrame, cutoff: int) -> DataFrame:
    return tasks.where(F.coalesce("last_used", F.lit(0)) < cutoff)


def sweep(blobs: DataFrame, tasks: DataFrame, cutoff: int) -> DataFrame:
    """Blobs that no live task reaches and that are older than the cutoff."""
    marked = blobs.join(live(tasks, cutoff).select("task"), "task", "left_semi").select("blob").distinct()
    return blobs.where(F.col("last_used") < cutoff).join(marked, "blob", "left_anti").select("blob", "last_used", "bytes")


def plan(blobs: DataFrame, tasks: DataFrame, cutoff: int) -> DataFrame:
    old = expired(tasks, cutoff).select(F.lit("tasks").alias("category"), F.col("task").alias("id"), "last_used", F.lit(0).cast("long").alias("bytes"))
    return old.unionByName(sweep(blobs, tasks, cutoff).select(F.lit("blobs").alias("category"), F.col("blob").alias("id"), "last_used", "bytes"))


def totals(planned: DataFrame) -> DataFrame:
    """Rows and bytes by category, and of all (category null)."""
    return planned.rollup("category").agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def human_bytes(size: Column) -> Column:
    """1024 steps up to TiB, with one decimal from KiB on."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(size >= 1024**i, F.concat(F.format_string("%.1f", F.bround(size / float(1024**i), 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def lock_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Versions that were locked anew replace all their platforms; others stay."""
    return old.join(new.select("tool", "version").distinct(), ["tool", "version"], "left_anti").unionByName(new)


def merge_config(settings: DataFrame) -> DataFrame:
    """``path``, ``value``: the last setting of each path, after the last null reset of it or of anything above.

    A null value at a path clears the path and all below it.
    """
    resets = settings.where("value is null").groupBy("namespace", "path").agg(F.max("seq").alias("_reset"))
    at = F.expr("transform(sequence(1, size(split(path, '[.]'))), n -> array_join(slice(split(path, '[.]'), 1, n), '.'))")
    rows = settings.where("value is not null").withColumn("_above", F.explode(at))
    above = resets.withColumnRenamed("path", "_above")
    cleared = rows.join(above, ["namespace", "_above"], "left").groupBy("namespace", "path", "value", "seq").agg(F.max("_reset").alias("_reset"))
    return latest(cleared.where("_reset is null or seq > _reset").drop("_reset"), ["namespace", "path"], ["seq"]).select("namespace", "path", "value")


#: Rows of a run of ``seq``, within which a running sum is one window.
RUN = 65_536


def running(events: DataFrame, delta: dict[str, Column], partition: list[str] = ()) -> DataFrame:
    """``events`` and, for each name of ``delta``, its running sum in the order of ``seq`` within ``partition``.

    ``seq`` is cut into runs of ``RUN`` numbers. A run's rows are one window, and so are the sums of the runs
    before it, a row each: no window grows with the rows of a hot partition.
    """
    keys = [*partition, "_run"]
    rows = events.withColumns({**{f"_d_{n}": d.cast("long") for n, d in delta.items()}, "_run": F.floor(F.col("seq") / RUN)})
    runs = rows.groupBy(*keys).agg(*(F.sum(f"_d_{n}").alias(f"_s_{n}") for n in delta))
    earlier = Window.partitionBy(*partition).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *(F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in delta))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    inside = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(before, same)
    return joined.select(*events.columns, *((F.col(f"_b_{n}") + F.sum(f"_d_{n}").over(inside)).alias(n) for n in delta))


def lock_verify(downloads: DataFrame, lock: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``verified``: the download's ``sha256`` and ``size`` are the locked ones, of those that are locked; null without a lock."""
    locked = lock.select(*keys, F.col("sha256").alias("_sha256"), F.col("size").alias("_size"), F.lit(True).alias("_locked"))
    right = lambda c: F.col(f"_{c}").isNull() | F.col(c).eqNullSafe(F.col(f"_{c}"))
    return downloads.join(locked, keys, "left").select(*keys, F.when(F.col("_locked"), right("sha256") & right("size")).alias("verified"))


def modes(targets: DataFrame, profiles: DataFrame, axes: dict[str, str], overrides: dict[str, str]) -> DataFrame:
    """``address``, ``axis``, ``value``: the override of an axis, else what the target's last profile sets, else the default.

    ``profiles``: ``address``, ``axis``, ``value``, ``seq``. ``axes`` (with defaults) and ``overrides`` are declared by name.
    """
    last = profiles.groupBy("address", "axis").agg(F.max_by("value", "seq").alias("_profile"))
    of = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(d).alias("default"), F.lit(overrides.get(a)).cast("string").alias("asked")) for a, d in axes.items())))
    every = targets.select("address", of.alias("a")).select("address", "a.*")
    return every.join(last, ["address", "axis"], "left").select("address", "axis", F.coalesce("asked", "_profile", "default").alias("value"))


def interned(calls: DataFrame, keys: list[str]) -> DataFrame:
    """``seq``, ``instance``: the first call with the same keys (nulls alike), or itself where it is not cached."""
    shared = hits(calls.where("cache"), keys, keep_first=True).select("seq", F.col("_first").alias("instance"))
    return shared.unionByName(calls.where("not cache").select("seq", F.col("seq").alias("instance")))


def toolchain_defaults(instances: DataFrame, requests: DataFrame) -> DataFrame:
    """``id``, ``version``, ``instance``, ``unverified`` of requests (``id``, ``tool``, ``version``).

    ``instances``: ``tool``, ``version``, ``seq``, ``is_default``, ``unverified``. The last default instance gives the
    version where none is asked for, and stands in for a version that nobody declares.
    """
    default = instances.where("is_default").groupBy("tool").agg(F.max_by(F.struct("version", "seq", "unverified"), "seq").alias("_d"))
    exact = instances.groupBy("tool", F.col("version").alias("_v")).agg(F.max_by(F.struct("seq", "unverified"), "seq").alias("_e"))
    rows = requests.join(default, "tool", "left").withColumn("_v", F.coalesce("version", "_d.version")).join(exact, ["tool", "_v"], "left")
    return rows.select("id", F.col("_v").alias("version"), F.coalesce("_e.seq", "_d.seq").alias("instance"), F.coalesce(F.when(F.col("_e").isNotNull(), F.col("_e.unverified")).otherwise(F.col("_d.unverified")), F.lit(False)).alias("unverified"))


def duplicate_handlers(attached: DataFrame) -> DataFrame:
    """``label``, ``goal``, ``fn``, ``n`` of functions attached twice to a label's goal (an error for the caller)."""
    return attached.groupBy("label", "goal", "fn").agg(F.count("*").alias("n")).where("n > 1")


def max_age_days(asked: Column, configured: Column) -> Column:
    return F.coalesce(asked, configured, F.lit(30)).cast("long")


def empty_containers(containers: DataFrame, entries: DataFrame) -> DataFrame:
    """``path`` of containers (folders of scopes or names) with nothing below them."""
    above = F.expr("transform(sequence(1, size(split(path, '/')) - 1), n -> array_join(slice(split(path, '/'), 1, n), '/'))")
    held = entries.where(F.col("path").contains("/")).select(F.explode(above).alias("path")).distinct()
    return containers.select("path").distinct().join(held, "path", "left_anti")


def effective(asked: Column, configured: Column, default: int = 1) -> Column:
    """A count that was asked for (1 at least), else the configured one as it is, else the default."""
    return F.coalesce(F.when(asked.isNotNull(), F.greatest(asked, F.lit(1))), configured, F.lit(default)).cast("long")


def lock_resolve(requests: DataFrame, files: DataFrame) -> DataFrame:
    """The requests (``address``, ``tool``, ``version``, ``platform``, ``unverified``) with ``url``, ``sha256``, ``reason``, ``fails``.

    ``files``: ``address`` and ``contents`` of each lock file. ``reason`` is the first that holds of the five
    why nothing is found; an unverified request then goes on without an entry, any other fails.
    """
    kind = "tool string, versions map<string, map<string, struct<url: string, sha256: string>>>"
    held = files.select("address", F.col("contents").alias("_contents"), F.try_parse_json("contents").isNotNull().alias("_valid"), F.from_json("contents", kind).alias("_lock"))
    rows = requests.join(held, "address", "left").withColumn("_of", F.try_element_at("_lock.versions", F.col("version")))
    rows = rows.withColumn("_entry", F.try_element_at("_of", F.col("platform")))
    reason = (
        F.when(F.col("_contents").isNull(), "no lock file").when(~F.col("_valid"), "not valid JSON").when(~F.col("_lock.tool").eqNullSafe(F.col("tool")), "other tool")
        .when(F.col("_of").isNull(), "unlocked version").when((F.coalesce("_entry.url", F.lit("")) == "") | (F.coalesce("_entry.sha256", F.lit("")) == ""), "unlocked platform")
    )
    rows = rows.withColumn("reason", reason)
    found = lambda c: F.when(F.col("reason").isNull(), F.col(f"_entry.{c}")).alias(c)
    return rows.select(*requests.columns, found("url"), found("sha256"), "reason", (F.col("reason").isNotNull() & ~F.coalesce("unverified", F.lit(False))).alias("fails"))
