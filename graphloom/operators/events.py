"""Task-lifecycle events folded into states, summaries and lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.store import running


def lifecycle(events: DataFrame) -> DataFrame:
    """Per id: when its clock started (Running resets Pending) and ended, and its last outcome."""
    at = lambda name: F.when(F.col("event") == name, F.col("moment"))
    rows = events.groupBy("id").agg(F.min(at("Pending")).alias("pending"), F.max(at("Running")).alias("running"), F.max(at("Done")).alias("done"), F.max_by("outcome", F.when(F.col("event") == "Done", F.col("seq"))).alias("outcome"))
    return rows.select("id", F.coalesce("running", "pending").alias("started"), F.col("done").alias("ended"), "outcome")


def summary(events: DataFrame) -> DataFrame:
    """One row of counts. ``Ok`` is cached, fresh in a sandbox, or fresh in the rule language by ``cached``."""
    done = events.where(F.col("event") == "Done")
    ok = F.col("outcome") == "Ok"
    counts = {
        "cached": ok & F.col("cached"), "cached_local": ok & F.col("cached") & (F.col("cache_source") == "local"), "cached_remote": ok & F.col("cached") & (F.col("cache_source") == "remote"),
        "fresh_sandbox": ok & ~F.col("cached"), "fresh_js": ok & F.col("cached").isNull(), "failed": F.col("outcome") == "Err", "canceled": F.col("outcome") == "Canceled",
    }
    return done.agg(*(F.count_if(c).alias(n) for n, c in counts.items()))


def hit_rate(summed: DataFrame) -> DataFrame:
    total = F.col("cached") + F.col("fresh_sandbox")
    return summed.select(F.round(100.0 * F.col("cached") / F.nullif(total, F.lit(0))).cast("long").alias("hit_rate"))


def lanes(events: DataFrame) -> DataFrame:
    """The task that holds each slot after all events: the last to start there, unless it was done since."""
    started = events.where("event = 'Running'").groupBy("slot").agg(F.max_by(F.struct("id", "seq"), "seq").alias("x")).select("slot", "x.id", "x.seq")
    ended = events.where("event = 'Done'").groupBy("slot", "id").agg(F.max("seq").alias("_done"))
    return started.join(ended, ["slot", "id"], "left").where("_done is null or _done < seq").select("slot", "id")


def progress(events: DataFrame) -> DataFrame:
    """Running totals of tasks announced and done, over all events."""
    return running(events, {"total": F.col("event") == "Pending", "done": F.col("event") == "Done"}).select("seq", "total", "done")
